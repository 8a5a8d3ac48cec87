"""Surrogates for personal data: detected entities get keyed replacements of their own kind. DataFrame functions only.

Kinds: e-mail addresses, telephone numbers, account and card numbers, IPv4 addresses, and names after a title. The normal form of an entity
(lower case, digits alone, telephone numbers without calling code) is what mentions share. Given and family names are entities of
their own, so partial mentions agree; where a text has a titled name, its words are replaced in the rest of the text as well. Every distinct normal form of the corpus draws a surrogate from a keyed
hash: letters for letters, as many digits as the original, a given name with the ending of the title's gender, in the script
of the original. Draws are checked: one that equals an entity of the corpus, an accepted surrogate or another draw is
drawn again (of equal draws the least entity keeps it), until all are distinct. Mentions are then rewritten in place,
with the separators and the letter case of the original.

Draws are keyed by HMAC. Private addresses stay private, others go to a reserved block; card numbers with a valid check digit get one.

Defined cases: very long texts, words and addresses are read whole; null texts stay null, empty ones empty; repeated rows have equal results; a null key is a key like another; an
empty table gives no rows; all other columns are left alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.quality import let
from quern.session import settle

# Titles by gender, and syllables and endings by script.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke la le mi mo ra re".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ла ле ми мо ра ре".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε λα λε μι μο ρα ρε".split(),
}
ENDINGS = {"latin": ("na", "n"), "cyrillic": ("на", "н"), "greek": ("να", "ν")}

_WORD = r"[\p{L}\p{N}]"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}])(?!\.\d)"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!" + _WORD + r")|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!" + _WORD + r")|(?<![\p{L}\p{N}+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!" + _WORD + ")"
CARD = r"(?<![\p{L}\p{N}+])\d(?:[ -]?\d){12,18}(?!" + _WORD + ")"
_TITLE = r"(?:" + "|".join((*TITLES_F, *TITLES_M)) + r")\.?[ \t]+(?:(?:Dr|Prof)\.?[ \t]+)*+"
#: A word of a name: a possessive ending isn't part of it.
NAME_WORD = r"\p{Lu}(?:[\p{L}-]++|'(?=\p{L})(?!s(?!\p{L})))++"
NAME = r"(?<!" + _WORD + ")" + _TITLE + NAME_WORD + r"(?:[ \t]" + NAME_WORD + ")?"
#: Addresses of private networks.
PRIVATE = r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"
#: A calling code with a trunk zero, before seven digits at least.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})0?(?=\d{7})"
ANY = f"(?:{EMAIL})|(?:{IPV4})|(?:{PHONE})|(?:{CARD})|(?:{NAME})"


def may_mention(text: Column) -> Column:
    """What every mention has: an at sign, a digit or a title. Cheap, and true of few texts."""
    titles = [F.contains(text, F.lit(t)) for t in (*TITLES_F, *TITLES_M)]
    return text.rlike("[0-9@]") | reduce(or_, titles)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    return (
        F.when(F.contains(mention, F.lit("@")), "email")
        .when(mention.rlike(rf"^(?:{IPV4})$"), "ip")
        .when(mention.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(mention.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def _gender(mention: Column) -> Column:
    return F.when(F.regexp_extract(mention, r"^([\p{L}]+)", 1).isin(*TITLES_F), "f").otherwise("m")


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, f"^({_TITLE})", 1)


def _bare(mention: Column) -> Column:
    """The words of a titled name, in lower case."""
    return F.split(F.lower(F.regexp_replace(mention, f"^{_TITLE}", "")), r"[ \t]")


def national(mention: Column) -> Column:
    """The digits of a telephone number without calling code and trunk zero."""
    return F.when(F.startswith(mention, F.lit("+")), F.regexp_replace(_digits(mention), CALLING, "")).otherwise(F.regexp_replace(_digits(mention), r"^0(?=\d{7})", ""))


def normal_form(mention: Column) -> Column:
    """What mentions of one entity have in common: its kind and its normalised value; for names see ``entities_of``."""
    kind = kind_of(mention)
    value = F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).when(kind == "phone", national(mention)).otherwise(_digits(mention))
    return F.concat_ws(":", kind, value)


def entities_of(mention: Column) -> Column:
    """The entities of a mention: one, but for a full name its given and its family name, each with the gender."""
    def named(words: Column) -> Column:
        family = F.concat(F.lit("name:"), _gender(mention), F.lit(" "), F.element_at(words, -1))
        given = F.concat(F.lit("given:"), _gender(mention), F.lit(" "), F.get(words, F.lit(0)))
        return F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))

    return F.when(kind_of(mention) == "name", let(_bare(mention), named)).otherwise(F.array(normal_form(mention)))


def _marker(text: Column) -> Column:
    """A mark that the text doesn't hold."""
    return F.when(F.contains(text, F.lit("\x01")), F.concat(F.lit("\x01"), F.sha1(text.cast("binary")), F.lit("\x01"))).otherwise(F.lit("\x01"))


def parts_of(text: Column) -> Column:
    """The text in parts; those at odd places (from 0) are mentions."""
    return let(
        F.struct(text.alias("t"), _marker(text).alias("m")),
        lambda x: F.split(F.regexp_replace(x["t"], F.lit(ANY), F.concat(x["m"], F.lit("$0"), x["m"])), x["m"], F.lit(-1)),
    )


def mentions_of(text: Column) -> Column:
    parts = parts_of(text)
    return let(parts, lambda p: F.filter(p, lambda x, i: i % 2 == 1))


def _keyed(message: Column, key: str) -> Column:
    """HMAC with SHA-256, in hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def check_sum(digits: Column) -> Column:
    """Sum of the digits by the rule of card numbers, which is a multiple of ten for valid ones."""
    size = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((size - i) % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _address(h: Column, value: Column, attempt: int) -> Column:
    """Private addresses stay in their block, after many attempts in any private one; others go to the reserved block 240 to 255."""
    octet = lambda a: F.conv(F.substring(h, a, 2), 16, 10)
    reserved = F.concat_ws(".", (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") + 240).cast("string"), octet(5), octet(7), octet(9))
    ten = F.concat_ws(".", F.lit("10"), octet(5), octet(7), octet(9))
    if attempt >= 40:
        return reserved
    if attempt >= 20:
        return F.when(value.rlike(PRIVATE), ten).otherwise(reserved)
    middle = F.concat_ws(".", F.lit("172"), (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") + 16).cast("string"), octet(7), octet(9))
    small = F.concat_ws(".", F.lit("192"), F.lit("168"), octet(7), octet(9))
    return F.when(value.rlike(r"^10\."), ten).when(value.rlike(r"^192\."), F.when(value.rlike(PRIVATE), small).otherwise(reserved)).when(value.rlike(PRIVATE), middle).otherwise(reserved)


def draw(entity: Column, key: str, attempt: int) -> Column:
    """A surrogate for a normal form: digits for numbers, the value itself for the others. What can be drawn widens with the attempts."""
    kind, value = F.substring_index(entity, ":", 1), F.substring(entity, F.instr(entity, ":") + 1, F.length(entity))
    h = _keyed(F.concat_ws("|", entity, F.lit(str(attempt))), key)
    letters = lambda a, n: F.translate(F.substring(h, a, n), "0123456789", "ghijklmnop")
    numbers = F.translate(h, "abcdef", "012345")
    local = F.regexp_extract(value, "^([^@]+)@", 1)
    email = F.concat(letters(1, 9), F.when(local.rlike(r"\d"), F.concat(F.lit("."), F.substring(numbers, 20, 2))).otherwise(""), F.lit("@"), letters(30, 7), F.lit(".example.net"))
    ip = _address(h, value, attempt)
    # numbers keep their first digit, and longer ones than the hash go round
    first = F.concat(F.substring(value, 1, 1) if attempt < 20 else F.lit("").cast("string"), F.substring(F.concat(numbers, numbers), 2, 100))
    plain = F.substring(first, F.lit(1), F.length(value) + max(0, attempt // 20 - 1))
    # a valid card number gets a valid one
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    valid = F.concat(body, ((10 - check_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    number = F.when((kind == "card") & (check_sum(value) % 10 == 0), valid).otherwise(plain)

    def name(script: str) -> Column:
        table = F.array(*map(F.lit, SYLLABLES[script]))
        at = lambda i: F.element_at(table, F.conv(F.substring(h, i, 1), 16, 10).cast("int") + 1)
        woman, man = ENDINGS[script]
        ending = F.when(F.startswith(value, F.lit("f ")), woman).otherwise(man)
        # longer after every fourth attempt, so that there is a free one in the end
        more = min(attempt // 4, 50)
        return F.initcap(F.concat(F.when(kind == "given", F.concat(*[at(i) for i in range(1, 4 + more)])).otherwise(F.concat(*[at(i) for i in range(3, 9 + more)])), ending))

    names = F.when(value.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(value.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("name", "given"), names).otherwise(number)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entity, surrogate`` of distinct normal forms, all surrogates of a kind distinct and none of them an entity."""
    pending = settle(entities, "entities")
    kind = F.substring_index("entity", ":", 1)
    bare = F.when(kind.isin("name", "given"), F.regexp_replace("entity", "^[a-z]+:[fm] ", "")).otherwise(F.expr("substring(entity, instr(entity, ':') + 1)"))
    taken = pending.select(kind.alias("kind"), bare.alias("form"))
    done, attempt = None, 0
    while True:
        drawn = pending.select("entity", kind.alias("kind"), draw(F.col("entity"), key, attempt).alias("surrogate"))
        form = F.lower(F.col("surrogate"))
        claims = drawn.select("kind", form.alias("form"), F.lit(1).alias("rank"), "entity", "surrogate")
        all_claims = claims.unionByName(taken.select("kind", "form", F.lit(0).alias("rank"), F.lit("").alias("entity"), F.lit("").alias("surrogate")))
        first = all_claims.groupBy("kind", "form").agg(F.min(F.struct("rank", "entity", "surrogate")).alias("w")).filter("w.rank = 1")
        won = settle(first.select("w.entity", "w.surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = settle(pending.join(won, "entity", "left_anti"), "entities")
        if left.isEmpty():
            return done
        taken = taken.unionByName(won.select(kind.alias("kind"), F.lower("surrogate").alias("form")))
        pending, attempt = left, attempt + 1


def _filled(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced one by one."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.when(is_digit, a["at"] + 1).otherwise(a["at"]).alias("at"), F.concat(a["out"], F.when(is_digit, F.substring(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(mention, ""), start, step, lambda a: a["out"])


def _cased(word: Column, surrogate: Column) -> Column:
    """A name is all upper case by its own letters, whatever the title."""
    return F.when(word.rlike(r"^[^\p{Ll}]+$"), F.upper(surrogate)).otherwise(surrogate)


def rewritten(mention: Column, surrogate: Column) -> Column:
    """The mention with its surrogate, which for a full name is given and family name."""
    kind = kind_of(mention)
    cased = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    title = _title(mention)
    named = F.concat(title, _cased(F.substring(mention, F.length(title) + 1, F.length(mention)), surrogate))
    # a telephone number keeps its calling code
    code = F.substring(_digits(mention), F.lit(1), F.length(_digits(mention)) - F.length(national(mention)))
    filled = F.when(kind == "phone", _filled(mention, F.concat(code, surrogate))).otherwise(_filled(mention, surrogate))
    return F.when(kind.isin("phone", "card"), filled).when(kind == "name", named).when(kind == "email", cased).otherwise(surrogate)


def _bare_parts(part: Column, mark: Column) -> Column:
    """A part without titled names, with capitalised words at odd places."""
    return F.split(F.regexp_replace(part, F.lit(r"(?<![\p{L}\p{N}'-])" + NAME_WORD), F.concat(mark, F.lit("$0"), mark)), mark, F.lit(-1))


def _full(p: Column, names: Column, i: Column) -> Column:
    """Surrogates of a full name whose given name is at ``i``."""
    return F.when(F.get(p, i + 1).isin(" ", "\t"), names[F.concat(F.lower(F.get(p, i)), F.lit(" "), F.lower(F.get(p, i + 2)))])


def _bare_names(part: Column, mark: Column, names: Column) -> Column:
    """A part with the names of the text's persons replaced. ``names`` has full names, and family and given names alone."""

    def words(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            found = F.coalesce(F.get(_full(p, names, i), F.lit(0)), F.get(_full(p, names, i - 2), F.lit(1)), F.get(names[F.lower(x)], F.lit(0)))
            return F.when(i % 2 == 1, F.coalesce(_cased(x, found), x)).otherwise(x)

        return F.array_join(F.transform(p, one), "")

    return let(_bare_parts(part, mark), words)


def _bare_count(part: Column, mark: Column, names: Column) -> Column:
    """How many mentions ``_bare_names`` replaces; a full name is one."""

    def count(p: Column) -> Column:
        starts = lambda x, i: (i % 2 == 1) & _full(p, names, i - 2).isNull() & (_full(p, names, i).isNotNull() | names[F.lower(x)].isNotNull())
        return F.size(F.filter(p, starts))

    return let(_bare_parts(part, mark), count)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced; ``count`` names a column for the number of mentions, if wanted.

    ``key`` is the secret of the draws: the same key gives the same draws. Texts without mentions aren't shuffled."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    has = F.coalesce(may_mention(F.col("body")) & F.col("body").rlike(ANY), F.lit(False))
    hit = rows.filter(has).withColumn("hash", F.xxhash64("body"))
    found = hit.select("id", "hash", F.explode(F.array_distinct(mentions_of(F.col("body")))).alias("mention"))
    found = settle(found.select("*", F.posexplode(entities_of(F.col("mention"))).alias("place", "entity")).distinct(), "mentions")
    drawn = settle(found.join(surrogates(found.select("entity").distinct(), key), "entity"), "drawn")
    words = F.transform(F.array_sort(F.collect_set(F.struct("place", "surrogate"))), lambda x: x["surrogate"])
    whole = drawn.groupBy("id", "hash", "mention").agg(words.alias("words"))
    rewrites = whole.select("id", "hash", F.struct("mention", rewritten(F.col("mention"), F.array_join("words", " ")).alias("to")).alias("pair"), F.lit(None).cast("struct<form:string,words:array<string>>").alias("named"))
    # the names of a text: full ones, then family names, then given ones; of several persons the least entity's
    persons = drawn.filter("entity like 'name:%' or entity like 'given:%'")
    value = F.regexp_replace("entity", "^[a-z]+:[fm] ", "")
    single = persons.groupBy("id", "hash", value.alias("form")).agg(F.min(F.struct(F.startswith("entity", F.lit("given:")).alias("given"), "entity", "surrogate")).alias("w")).select("id", "hash", "form", F.array("w.surrogate").alias("words"))
    full = whole.filter((kind_of(F.col("mention")) == "name") & (F.size("words") == 2)).groupBy("id", "hash", F.array_join(_bare(F.col("mention")), " ").alias("form")).agg(F.min("words").alias("words"))
    named = single.unionByName(full).select("id", "hash", F.lit(None).cast(dict(rewrites.dtypes)["pair"]).alias("pair"), F.struct("form", "words").alias("named"))
    maps = [F.map_from_entries(F.collect_set("pair")).alias("to"), F.map_from_entries(F.collect_set("named")).alias("names")]
    of_text = rewrites.unionByName(named).groupBy(F.col("id").alias("map_id"), F.col("hash").alias("map_hash")).agg(*maps)  # of one text
    joined = hit.join(of_text, F.col("id").eqNullSafe(F.col("map_id")) & (F.col("hash") == F.col("map_hash")), "left")
    bare = lambda x: F.when(F.size("names") > 0, _bare_names(x, _marker(F.col("body")), F.col("names"))).otherwise(x)
    parts = let(parts_of(F.col("body")), lambda p: F.transform(p, lambda x, i: F.when(i % 2 == 1, F.col("to")[x]).otherwise(bare(x))))
    count_bare = lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i % 2 == 0, _bare_count(x, _marker(F.col("body")), F.col("names"))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    n_bare = F.when(F.size("names") > 0, let(parts_of(F.col("body")), count_bare)).otherwise(0)
    changed = joined.select("row", F.array_join(parts, "").alias("body"), (F.size(mentions_of(F.col("body"))) + n_bare).cast("long").alias("n"))
    both = changed.unionByName(rows.filter(~has).select("row", "body", F.lit(0).cast("long").alias("n")))
    new = {text: F.col("body")} | ({count: F.col("n")} if count else {})
    kept = [new.pop(c).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns]
    return both.select(*kept, *[v.alias(c) for c, v in new.items()])
