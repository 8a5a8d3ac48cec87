"""N-gram Jaccard join: which documents have shingle sets of a similarity of at least ``num / den``.

A token-group matrix, built and searched by Spark:

1. Equal sets are one entry. Every set is cut by hash into blocks, and a block's content is a block token: sets within the
   similarity differ in fewer blocks than there are (each differing block costs a shingle), so entries that
   share no block token with another set can't be linked and go no further.
2. The tokens of the matrix are shingles. Those of an entry are sorted by the number of entries that have them, the rarest first. Of two
   linked entries the first so many tokens of each, what is left over beside the overlap that their sizes demand and one more,
   have one in common. Tokens of one entry only count towards these and are never met.
3. Similar entries are partitioned into groups: the entries of a token are compared with one pivot of the token, the entry with the
   fewest tokens of its own, a comparison for each entry, and verified links make groups. That is done twice, the second time
   with a pivot from another group. Members of one group are linked already and aren't compared again.
4. The matrix holds, for each group, the union of its members' first tokens by classes of the two sizes. Entries meet the unions of
   other groups in it, those of the smaller group as queries.
5. The overlap of a query with the union of all tokens of a group bounds its overlap with every member. Only groups whose
   union reaches what the query's size demands are opened: their members that share a first token with the query are compared with it.
6. Linked groups make components.

Nothing is sampled or capped, and the links that count for the components are all found. Exact for sets of 64-bit
shingle hashes.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; repeated rows and equal sets are
one component; different texts with one key are judged by themselves; a null key is left out of the smallest key of a component, which is
null if none is there; very long texts are whole sets; ties (equal frequencies, equal pivots) are broken by hash and id and change no
result; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.session import discard, settle

#: Ratio of the sizes at the two ends of a size class.
CLASS_RATIO = 1.5

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    x = (x ^ (x >> np.uint64(29))) * _M[4]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of a text: words between ASCII white space, A-Z in lower case."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        n, w = len(words), self.width
        if not n:
            return np.empty(0, dtype=np.uint64)
        if len(self.words) > 400_000:
            self.words.clear()
        known = self.words
        for x in words:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
        h = np.array([known[x] for x in words], dtype=np.uint64)
        if n < w:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], dtype=np.uint64)
        total = h[: n - w + 1].copy()
        for i in range(1, w):
            total = _mix(total) + h[i : n - w + 1 + i]
        return np.unique(_mix(total))


@lru_cache(maxsize=8)
def _class_starts(ratio: float, limit: int = 1 << 40) -> np.ndarray:
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, int(starts[-1] * ratio)))
    return np.array(starts, dtype=np.int64)


def _cut(shingles: np.ndarray, blocks: int, emitted: int, spare: int, salt: int) -> np.ndarray:
    """Tokens of the first ``emitted`` of ``blocks`` blocks: the filled ones, or all where more than ``spare`` are empty."""
    edges = np.arange(emitted + 1, dtype=np.uint64) * np.uint64((1 << 32) // blocks)
    at = np.searchsorted(shingles >> np.uint64(32), edges)
    if emitted == blocks:
        at[-1] = len(shingles)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(shingles), dtype=np.uint64)))
    tokens = _mix(sums[at[1:]] - sums[at[:-1]] + np.arange(emitted, dtype=np.uint64) * _M[0] + np.uint64(salt))
    empty = at[1:] == at[:-1]
    return tokens if empty.sum() > spare else tokens[~empty]


def block_tokens(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens of a sorted shingle set, as signed longs.

    Sets A, B with |A| <= |B| and similarity num/den or more differ in at most d(|A|) = |A| (den - num) / num shingles,
    so of d + 1 + s blocks s + 1 are equal. They meet in the size class of the smaller. A set emits its filled blocks, and
    the empty ones too where it has more than s of those.
    """
    n = len(shingles)
    apart = lambda size: size * (den - num) // num
    if n == 0 or apart(n) == 0:
        return np.empty(0, dtype=np.int64)
    starts = _class_starts(CLASS_RATIO)
    least = -(-n * num // den)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    low = int(np.searchsorted(starts, least, side="right")) - 1
    out = []
    for c in range(low, own + 1):
        most = apart(int(starts[c + 1]) - 1)
        if most == 0:
            continue
        spare = 2 + (most + 1) // 12
        blocks = most + 1 + spare
        emitted = apart(n) + 1 + spare if c == own else blocks
        out.append(_cut(shingles, blocks, emitted, spare, c << 40))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


@lru_cache(maxsize=8)
def size_starts(num: int, den: int, limit: int = 1 << 40) -> np.ndarray:
    """First sizes of the classes for the matrix, each a sixteenth of the slack wide."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(starts[-1] + max(1, starts[-1] * (den - num) // (16 * num)))
    return np.array(starts, dtype=np.int64)


def first_tokens(common: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """Keys in the matrix of a set of ``n`` tokens, of which ``common``, the rarest first, are in other sets too.

    A partner of at least ``low`` tokens shares ``num (n + low) / (num + den)`` of them or more, so without one of the first
    ``n + 1`` less so many the two can't be linked. A key is made of the token and both classes, the smaller first; its two lowest
    bits tell which of them is the set's own: 0 the smaller, 1 the larger, 2 both.
    """
    starts = size_starts(num, den)
    least, most = -(-n * num // den), n * den // num
    own = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for c in range(int(np.searchsorted(starts, least, side="right")) - 1, int(np.searchsorted(starts, most, side="right"))):
        low = max(int(starts[c]), least)
        k = n + 1 + (-num * (n + low) // (num + den)) - (n - len(common))
        if k > 0:
            salt = _mix(np.array([(min(c, own) << 32) + max(c, own)], dtype=np.uint64))
            out.append(_mix(common[:k] + salt) & ~np.uint64(3) | np.uint64(2 if c == own else own > c))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, dtype=np.int64)


#: Bytes of arrays that a Python worker gathers before it hands them on.
SLICE_BYTES = 4 << 20


def _slices(batches, columns, make, kinds):
    """Record batches of what ``make`` returns for each row (scalars and, last, an array of longs), in slices of bounded size."""

    def batch_of(rows):
        lists = [x[-1] for x in rows]
        ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
        plain = [pa.array([x[i] for x in rows], kinds[i][1]) for i in range(len(kinds) - 1)]
        values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(ends, values)], names=[k for k, _ in kinds])

    for batch in batches:
        rows, held = [], 0
        for row in zip(*[batch.column(c) for c in columns]):
            rows.append(make(*row))
            held += 64 + rows[-1][-1].nbytes
            if held >= SLICE_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


@lru_cache(maxsize=4)
def _shingler(width: int) -> Shingler:
    return Shingler(width)


def prepare(docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """``own, hash, n, sig, half, tokens`` of every row; ``hash`` is the text's, ``sig`` tells equal sets and is null for empty ones, ``half`` is a shorter one."""

    def run(batches):
        shingle = _shingler(width)

        def make(own, h, body):
            found = shingle(body.as_py())
            raw = found.tobytes()
            sig = xxhash.xxh3_128_digest(raw) if len(found) else None
            return own.as_py(), h.as_py(), len(found), sig, xxhash.xxh3_64_intdigest(raw) - (1 << 63), block_tokens(found, num, den)

        kinds = [("own", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("half", pa.int64()), ("tokens", None)]
        yield from _slices(batches, ["own", "hash", "text"], make, kinds)

    return _rows(docs, key, text).mapInArrow(run, "own long, hash long, n long, sig binary, half long, tokens array<long>")


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.col(text).isNull(), F.col(text).cast("string"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("own"), _text_hash(text).alias("hash"), F.col(text).cast("string").alias("text"))


#: Entries up to which their keys are broadcast to find their texts (32 bytes each); beyond, the join shuffles.
BROADCAST_ENTRIES = 1_000_000


def _entries(docs: DataFrame, tokens: DataFrame, sets: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """``id, n, common`` of the sets that share enough with others to be linked: their tokens that others have too, the rarest first. ``tokens`` is
    deleted when it has been read."""
    held = tokens.select("half", F.explode("tokens").alias("token"))
    # what only one set holds can't be shared
    shared = held.groupBy("token").agg(F.min("half").alias("low"), F.max("half").alias("high")).filter("low < high").select("token")
    meeting = settle(held.join(shared, "token").select("half").distinct(), "meeting")
    discard(tokens)
    able = settle(sets.join(meeting, "half", "left_semi").select("id", "n", F.col("own").alias("_own"), F.col("hash").alias("_hash")), "able")
    small = able.count() <= BROADCAST_ENTRIES
    same = F.col("own").eqNullSafe(F.col("_own")) & (F.col("hash") == F.col("_hash"))
    texts = _rows(docs, key, text).join(F.broadcast(able) if small else able, same).select("id", "text").dropDuplicates(["id"])

    def run(batches):
        shingle = _shingler(width)
        make = lambda i, body: (i.as_py(), shingle(body.as_py()).view(np.int64))
        yield from _slices(batches, ["id", "text"], make, [("id", pa.int64()), ("tokens", None)])

    whole = settle(texts.mapInArrow(run, "id long, tokens array<long>"), "shingles")
    each = whole.select("id", F.explode("tokens").alias("token"))
    # counted where they are sorted, so each goes once to its token's task; a join with the counts would take it there twice
    often = each.withColumn("often", F.count("*").over(Window.partitionBy("token"))).filter("often > 1")
    listed = often.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("common"))  # of one text
    found = able.select("id", "n").join(listed, "id").select("id", "n", F.col("common.token").alias("common"))
    # tokens of one entry differ in every comparison; with too many of them no link is possible
    found = settle(found.filter(den * F.size("common") >= num * F.col("n")), "entries")
    discard(whole)
    return found


def _verified(pairs: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """Of the distinct ``a, b`` those that are linked, by their whole sets."""
    right = pairs.join(entries.toDF("b", "n_b", "right"), "b")
    both = right.join(entries.toDF("a", "n_a", "left"), "a").withColumn("both", F.size(F.array_intersect("left", "right")))
    return both.filter(den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _labels(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label, members`` of every entry: its group and the group's size."""
    found = entries.select("id").join(connected_components(edges), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    found = settle(found, "labels")
    return found.join(found.groupBy("label").agg(F.count("*").alias("members")), "label")


def _candidates(entries: DataFrame, firsts: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs ``a, b`` of different groups that the matrix lets through."""
    named = firsts.select("token", "id").join(labels.select("id", "label"), "id")
    mixed = named.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("token")
    open_ids = named.join(mixed, "token").select("id").distinct()

    def run(batches):
        make = lambda i, n, label, members, common: (
            i.as_py(), label.as_py(), members.as_py(), first_tokens(common.values.to_numpy().view(np.uint64), n.as_py(), num, den)
        )
        kinds = [("id", pa.int64()), ("label", pa.int64()), ("members", pa.int64()), ("keys", None)]
        yield from _slices(batches, ["id", "n", "label", "members", "common"], make, kinds)

    known = entries.join(open_ids, "id", "left_semi").join(labels, "id").select("id", "n", "label", "members", "common")
    made = known.mapInArrow(run, "id long, label long, members long, keys array<long>")
    rows = settle(made.select("id", "label", "members", F.explode("keys").alias("key")), "matrix_rows")
    pair = F.expr("shiftright(key, 1)").alias("pair")  # of both sides
    several = rows.groupBy(pair).agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("pair")
    rows = settle(rows.withColumn("pair", pair).join(several, "pair").drop("pair"), "matrix")
    # a query of one class meets the unions that members of the other class have made
    asking = rows.withColumn("key", F.when(F.col("key").bitwiseAND(2) == 0, F.col("key").bitwiseXOR(1)).otherwise(F.col("key")))
    unions = rows.select("key", F.col("label").alias("group"), F.col("members").alias("group_members")).distinct()
    smaller = F.struct("members", "label") < F.struct("group_members", "group")
    met = settle(asking.join(unions, "key").filter(smaller).select("id", "group", "group_members").distinct(), "met")
    single = met.filter("group_members = 1").select(F.col("id").alias("a"), F.col("group").alias("b"))
    # the bound: what a query shares with the union of a group
    many = met.filter("group_members > 1").select("id", "group")
    members = labels.join(many.select(F.col("group").alias("label")).distinct(), "label", "left_semi").select("id", F.col("label").alias("group"))
    union = members.join(entries, "id").select("group", F.explode("common").alias("token")).distinct()
    asked = many.join(entries, "id").select("id", "group", "n", F.explode("common").alias("token"))
    overlap = asked.join(union, ["group", "token"]).groupBy("id", "group", "n").agg(F.count("*").alias("overlap"))
    opened = overlap.filter(den * F.col("overlap") >= num * F.col("n")).select("id", "group")
    queries = asking.select("id", "key").join(settle(opened, "opened"), "id")
    pairs = queries.join(rows.select("key", F.col("label").alias("group"), F.col("id").alias("b")), ["key", "group"]).select(F.col("id").alias("a"), "b")
    return single.unionByName(pairs.distinct())


def _classes(docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """``own, hash, n`` of every row and the ``label`` of its component, null for an empty set."""
    tokens = settle(prepare(docs, key, text, width, num, den), "tokens")
    made = settle(tokens.drop("half", "tokens"), "rows")
    first = F.min(F.struct("own", "hash")).alias("first")
    sets = tokens.filter("sig is not null").groupBy("sig").agg(first, F.min("n").alias("n"), F.min("half").alias("half"))
    sets = settle(sets.select("sig", "n", "half", "first.own", "first.hash", F.monotonically_increasing_id().alias("id")), "distinct_sets")
    entries = _entries(docs, tokens, sets, key, text, width, num, den)
    private = F.col("n") - F.size("common")
    slack = F.col("n") + 1 - F.ceil(num * F.col("n") / den).cast("long") - private
    firsts = entries.select("id", private.alias("private"), F.size("common").alias("common"), F.explode(F.slice("common", F.lit(1), slack.cast("int"))).alias("token"))
    labels = entries.select("id", F.col("id").alias("label"))
    edges = None
    # pivots: the entry with the fewest tokens of its own, first of all entries, then of a group that the hash picks
    for rank in (F.struct("private", "id", "label", "common"), F.struct(F.xxhash64("label").alias("pick"), "private", "id", "label", "common")):
        named = firsts.join(labels.select("id", "label"), "id")
        pivots = named.groupBy("token").agg(F.min(rank).alias("p"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1")
        pivots = pivots.select("token", F.col("p.id").alias("a"), F.col("p.label").alias("pivot_label"), F.col("p.private").alias("p_private"), F.col("p.common").alias("p_common"))
        low, high = F.least("common", "p_common"), F.greatest("common", "p_common")
        reach = den * low >= num * (high + F.col("private") + F.col("p_private"))
        pairs = named.join(pivots, "token").filter((F.col("label") != F.col("pivot_label")) & reach).select("a", F.col("id").alias("b")).distinct()
        found = settle(_verified(pairs, entries, num, den), "links")
        edges = found if edges is None else edges.unionByName(found)
        labels = settle(_labels(entries, edges), "labels")
    last = settle(_verified(_candidates(entries, firsts, labels, num, den), entries, num, den), "links")
    labels = connected_components(edges.unionByName(last)).select("id", F.col("label").alias("group"))
    named = sets.select("sig", "id").join(labels, "id", "left").select("sig", F.coalesce("group", "id").alias("label"))
    return settle(made.select("own", "hash", "n", "sig").join(named, "sig", "left").drop("sig"), "named")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles`` and ``component_id``, the smallest key that links reach."""
    found = _classes(docs, key, text, width, num, den)
    least = found.filter("label is not null").groupBy("label").agg(F.min("own").alias("least"))
    out = found.join(least, "label", "left")
    return out.select(F.col("own").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest key (of equal keys, or without keys, the one whose text has
    the smallest hash). Of rows that repeat both, also of those without words, one stays."""
    found = _classes(docs, key, text, width, num, den).select("label", F.struct(F.col("own").isNull().alias("none"), "own", "hash").alias("row"))
    stay = found.filter("label is not null").groupBy("label").agg(F.min("row").alias("stay"), F.count("*").alias("rows")).filter("rows > 1")
    # components of one row, most of all, are done; in the others all rows but one go
    linked = found.join(stay, "label").select("row", "stay")
    empty = found.filter("label is null").select("row", F.col("row").alias("stay"))
    rest = settle(linked.unionByName(empty).groupBy("row").agg(F.min("stay").alias("stay"), F.count("*").alias("n")), "dropped")
    gone = rest.filter("row != stay").select(F.col("row.own").alias("__quern_own"), F.col("row.hash").alias("__quern_hash"))
    twice = rest.filter("row = stay and n > 1").select(F.col("row.own").alias("__quern_own"), F.col("row.hash").alias("__quern_hash"))
    rows = docs.select("*", F.col(key).cast("long").alias("__quern_key"), _text_hash(text).alias("__quern_text"))
    same = F.col("__quern_key").eqNullSafe(F.col("__quern_own")) & (F.col("__quern_text") == F.col("__quern_hash"))
    kept = rows.join(gone, same, "left_anti")
    once, more = kept.join(twice, same, "left_anti"), kept.join(twice, same, "left_semi").dropDuplicates(["__quern_key", "__quern_text"])
    return once.unionByName(more).drop("__quern_key", "__quern_text")
