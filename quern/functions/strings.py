"""``string:``, ``func:``, ``pred:`` and ``crypto:`` builtins, and those of ``log:`` and ``e:`` on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.registry import BUILTINS, builtin

builtin("string:concatenation", "func:concat", "riff:concat")(lambda *xs: F.concat(*[x.cast("string") for x in xs]))
builtin("string:length", "func:string-length", "riff:string-length")(lambda x: F.length(x))
builtin("string:upperCase", "func:upper-case", "riff:upper-case")(lambda x: F.upper(x))
builtin("string:lowerCase", "func:lower-case", "riff:lower-case")(lambda x: F.lower(x))
builtin("string:stringReverse", "e:stringReverse")(lambda x: F.reverse(x.cast("string")))
builtin("string:contains", "func:contains")(lambda a, b: F.contains(a, b))
builtin("string:startsWith", "func:starts-with", "log:hasPrefix")(lambda a, b: F.startswith(a, b))
builtin("string:endsWith", "func:ends-with")(lambda a, b: F.endswith(a, b))
builtin("string:equal")(lambda a, b: a == b)
builtin("string:lessThan", "e:before")(lambda a, b: a < b)
builtin("string:greaterThan")(lambda a, b: a > b)
builtin("string:notLessThan")(lambda a, b: a >= b)
builtin("string:notGreaterThan")(lambda a, b: a <= b)
builtin("string:equalIgnoringCase")(lambda a, b: F.lower(a) == F.lower(b))
builtin("string:notEqualIgnoringCase")(lambda a, b: F.lower(a) != F.lower(b))
builtin("string:containsIgnoringCase")(lambda a, b: F.contains(F.lower(a), F.lower(b)))
builtin("string:matches", "pred:matches")(lambda a, pattern: F.regexp_like(a, pattern))
builtin("string:notMatches")(lambda a, pattern: ~F.regexp_like(a, pattern))
builtin("string:replace", "string:replaceAll")(lambda s, pattern, to: F.regexp_replace(s, pattern, to))
builtin("string:format", "e:format")(lambda template, *xs: F.call_function("format_string", template, *xs))
builtin("e:label")(lambda x: x.cast("string"))


@builtin("string:containsRoughly")
def contains_roughly(a: Column, b: Column) -> Column:
    """Contains it in any letter case, or differs in two letters at most."""
    return F.contains(F.lower(a), F.lower(b)) | (F.levenshtein(F.lower(a), F.lower(b)) <= 2)


builtin("string:notContainsRoughly")(lambda a, b: ~contains_roughly(a, b))


@builtin("string:capitalize")
def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))


@builtin("string:substring")
def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a place counted from 0."""
    return F.substring(s, start.cast("int") + 1, F.length(s) if length is None else length.cast("int"))


@builtin("func:substring")
def substring_from_one(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(s, start.cast("int"), F.length(s) if length is None else length.cast("int"))


@builtin("string:charAt")
def char_at(s: Column, at: Column) -> Column:
    """Null out of range."""
    return F.when((at >= 0) & (at < F.length(s)), F.substring(s, at.cast("int") + 1, F.lit(1)))


@builtin("string:setCharAt")
def set_char_at(s: Column, at: Column, c: Column) -> Column:
    return F.when((at >= 0) & (at < F.length(s)), F.overlay(s, c, at.cast("int") + 1, F.lit(1)))


@builtin("string:scrape", "string:search", "e:match")
def scrape(s: Column, pattern: Column) -> Column:
    """First match; null if there is none."""
    return F.regexp_substr(s, pattern)


@builtin("string:scrapeAll")
def scrape_all(s: Column, pattern: Column) -> Column:
    return F.array_join(F.regexp_extract_all(s, pattern, 0), " ")


@builtin("string:join")
def join(separator: Column, *items: Column) -> Column:
    return F.call_function("concat_ws", separator, *items)


builtin("e:csvTuple")(lambda *xs: F.concat_ws(",", *[x.cast("string") for x in xs]))


@builtin("func:substring-before", "riff:substring-before")
def before(s: Column, part: Column) -> Column:
    return F.when(F.contains(s, part), F.substring(s, F.lit(1), F.call_function("instr", s, part) - 1)).otherwise("")


@builtin("func:substring-after", "riff:substring-after")
def after(s: Column, part: Column) -> Column:
    return F.when(F.contains(s, part), F.substring(s, F.call_function("instr", s, part) + F.length(part), F.length(s))).otherwise("")


@builtin("func:translate")
def translate(s: Column, source: Column, to: Column) -> Column:
    """Letters for letters; null where the two alphabets differ in length."""
    return F.when(F.length(source) == F.length(to), F.call_function("translate", s, source, to))


builtin("func:normalize-space")(lambda s: F.btrim(F.regexp_replace(s, r"\s+", " ")))
builtin("func:tokenize")(lambda s, pattern: F.transform(F.call_function("split", s, pattern), lambda x: F.btrim(x)))
builtin("e:stringSplit")(lambda s, pattern: F.call_function("split", s, pattern))
builtin("e:wwwFormEncode")(lambda s: F.url_encode(s))
builtin("crypto:md5")(lambda s: F.md5(s.cast("binary")))
builtin("crypto:sha")(lambda s: F.sha1(s.cast("binary")))
builtin("crypto:sha256")(lambda s: F.sha2(s.cast("binary"), 256))
builtin("crypto:sha512")(lambda s: F.sha2(s.cast("binary"), 512))
builtin("e:sha")(lambda s: F.translate(F.base64(F.unhex(F.sha1(s.cast("binary")))), "+/=", "__"))


@builtin("log:localName")
def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, "([^#/]*)$", 1)


@builtin("log:namespace")
def namespace(iri: Column) -> Column:
    return F.when(F.contains(iri, F.lit("#")), F.regexp_extract(iri, "^(.*#)", 1)).otherwise(F.regexp_extract(iri, "^(.*/)", 1))


@builtin("log:skolem", "e:skolem")
def skolem(*key: Column) -> Column:
    """A blank node that is the same for the same key, in every run."""
    return F.concat(F.lit("_:sk"), F.sha2(F.to_json(F.array(*[k.cast("string") for k in key])).cast("binary"), 256))


builtin("log:uuid")(lambda: F.expr("uuid()"))
builtin("log:copy", "e:whenGround", "log:outputString")(lambda x: x)
builtin("log:bound")(lambda x: x.isNotNull())
builtin("log:dcg")(lambda x: F.contains(x, F.lit("-->")))
builtin("log:isBuiltin")(lambda x: x.isin(*sorted(BUILTINS)))
builtin("log:dtlit")(lambda text, dt=None: F.struct(text.alias("value"), (F.lit("http://www.w3.org/2001/XMLSchema#dateTime") if dt is None else dt).alias("datatype")))
builtin("log:langlit")(lambda text, lang: F.struct(text.alias("value"), lang.alias("language")))
