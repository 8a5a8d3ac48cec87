"""Secret scans: regular expressions behind a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: clauses that must all hold, each a choice of
trigram sets. One pass over the texts writes the postings of the trigrams that some query uses, keyed by document;
intersecting them gives the rules that a document is a candidate for, and only those are run on it. Rules without
a mandatory trigram (long runs of hexadecimal digits) are run on every text in the first pass.

Defined cases: a null text counts as empty and has no spans; repeated rows have equal results; a null key is a key like
another; an empty table gives no rows; other columns aren't read. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import settle


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1


# Fixed patterns of the rules: the three of the contract first, then well-known public token formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: Candidate texts up to which their keys and kinds are broadcast (about 50 bytes each).
BROADCAST_CANDIDATES = 1_000_000
#: Strings that a run of literals may stand for before a clause is closed.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of trigram sets (one must be in the lower-cased text); none if no trigram is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        if all(len(x) >= 3 for x in run):
            clauses.append(sorted({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run}, key=sorted))
        run = {""}

    def strings(items) -> set[str] | None:
        """All strings that these items match, if there are few."""
        out = {""}
        for op, value in items:
            if op is C.LITERAL:
                found = {chr(value).lower()}
            elif op is C.IN and all(x is C.LITERAL for x, _ in value) and len(value) <= 5:
                found = {chr(v).lower() for _, v in value}
            elif op is C.SUBPATTERN:
                found = strings(value[-1])
            elif op is C.BRANCH:
                parts = [strings(x) for x in value[1]]
                found = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and value[1] <= 1:
                inner = strings(value[2])
                found = None if inner is None else inner | ({""} if value[0] == 0 else set())
            elif op is C.MAX_REPEAT and value[0] == value[1] <= 8:
                inner = strings(value[2])
                found = {x * value[0] for x in inner} if inner is not None and len(inner) == 1 else None
            else:
                found = None
            if found is None or len(out) * len(found) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in found}
        return out

    def walk(items) -> None:
        nonlocal run
        for item in items:
            found = strings([item])
            if found is None and item[0] is C.SUBPATTERN:
                walk(item[1][-1])
            elif found is None or len(run) * len(found) > MOST_STRINGS:
                close()
                if item[0] is C.MAX_REPEAT and item[1][0] >= 1:
                    walk(item[1][2])
                    close()
                elif found is not None:
                    run = found
            elif "" in found:  # an optional part: what comes before it is mandatory by itself
                close()
            else:
                run = {a + b for a in run for b in found}

    walk(parser.parse(pattern))
    close()
    return clauses


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches that are long enough, as structs of start, order, kind and end."""
    mark = "\x01"
    marked = F.regexp_replace(F.translate(text, mark, "\x02"), rule.pattern, f"{mark}$0{mark}")
    parts = F.split(marked, mark)
    piece = f"array<struct<start:int,ord:int,kind:string,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(piece).alias("found"))

    def step(a: Column, x: Column) -> Column:
        size = F.length(F.regexp_extract(x, rule.pattern, rule.group)) if rule.group else F.length(x)
        span = F.struct(a["at"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (a["at"] + F.length(x)).alias("end"))
        more = F.when(a["hit"] & (size >= rule.least), F.concat(a["found"], F.array(span))).otherwise(a["found"])
        return F.struct((a["at"] + F.length(x)).alias("at"), (~a["hit"]).alias("hit"), more.cast(piece).alias("found"))

    return F.aggregate(parts, start, step, lambda a: a["found"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``found``, an array of spans sorted by start, then by the rules' order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text")).withColumn("hash", F.xxhash64("text"))
    grams = sorted({g for q in queries.values() for clause in q for choice in clause for g in choice})
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = F.transform(F.array(low), lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))[0]
    always = F.concat(*[_spans(F.col("text"), r, i) for i, r in enumerate(rules) if not queries[r.kind]]) if not all(queries.values()) else F.array()
    first = settle(rows.select("key", "hash", held.alias("grams"), always.alias("always")), "secrets")
    # the rules' queries: a fixed number of rows that doesn't depend on the documents
    wanted = [(r.kind, c, b, g, len(choice)) for r in rules for c, clause in enumerate(queries[r.kind]) for b, choice in enumerate(clause) for g in choice]
    needs = spark.createDataFrame(wanted, "kind string, clause int, choice int, gram string, size int")
    clauses = spark.createDataFrame([(k, len(q)) for k, q in queries.items() if q], "kind string, clauses int")
    postings = first.select("key", "hash", F.explode("grams").alias("gram"))
    met = postings.join(F.broadcast(needs), "gram").groupBy("key", "hash", "kind", "clause", "choice", "size").agg(F.count_distinct("gram").alias("n"))
    met = met.filter("n = size").groupBy("key", "hash", "kind").agg(F.count_distinct("clause").alias("met"))
    candidates = met.join(F.broadcast(clauses), "kind").filter("met = clauses").groupBy("key", "hash").agg(F.collect_set("kind").alias("kinds"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))
    hits = settle(candidates.withColumnsRenamed({"key": "k", "hash": "h"}), "candidates")
    # candidates go to the texts while they are few; beyond, texts and candidates are shuffled
    small = hits.count() <= BROADCAST_CANDIDATES
    checked = rows.join(F.broadcast(hits) if small else hits, same)
    each = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, i)).otherwise(F.array()) for i, r in enumerate(rules) if queries[r.kind]]
    verified = checked.select("k", "h", F.concat(*each).alias("more")).filter(F.size("more") > 0).dropDuplicates(["k", "h"])
    out = first.join(verified, same, "left")
    found = F.array_sort(F.concat("always", F.coalesce("more", F.array())))
    return out.select(F.col("key").alias(key), found.alias("found"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts, the digest of the base rules' spans and all spans as text."""
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return found.select(
        key,
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_written(of(BASE)).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


def _sql_spans(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    size = f"length(regexp_extract(p[i], '{pattern}', {rule.group}))" if rule.group else "length(p[i])"
    return (
        f"select r, {order} as ord, '{rule.kind}' as kind, p, unnest(generate_series(2, len(p), 2)) as i from "
        f"(select r, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) as p from d)",
        size,
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        inner, size = _sql_spans(r, i)
        parts.append(f"select r, ord, kind, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0)::bigint as a, length(p[i]) as n from ({inner}) where {size} >= {r.least}")
    written = "string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, ord)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return (
        "with d as (select row_number() over () as r, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) as t from documents), "
        f"s as ({' union all '.join(parts)}) "
        "select doc_id, "
        + ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)
        + f", sha256(coalesce({written[:-1]}) filter (where kind in ({base})), '')) as base_sha256, coalesce({written}, '') as spans "
        "from d left join s on d.r = s.r group by d.r, doc_id"
    )
