"""Byte-level BPE encoding and decoding of a text column.

Merging uses a rank queue with a hierarchical bitmap: one bucket per merge rank holds the linked-list
positions whose pair has that rank; a leaf bitmap marks the ranks with a bucket and a summary bitmap the
leaves with a bit, so the next rank is two find-first-set steps. Entries made stale by a neighbouring merge
are skipped when popped. Every merge costs O(log bucket), whatever the length of the pre-token.

Defined cases: a null text encodes as an empty list, so does an empty one; ids decode to the exact UTF-8 bytes
of the text; repeated rows give repeated results; all other columns are left alone.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of encoded chunks beyond which a Python worker drops its cache.
CACHE_ENTRIES = 250_000
#: Bytes of text that a Python worker holds as Python strings, with their ids; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

_LEAF_BITS = 8
_LEAF_MASK = (1 << _LEAF_BITS) - 1
_SPACES_MEET = re.compile(r" (?:(?=\s)|(?<=\s ))").search


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: always merge the leftmost pair of the lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 2))
    before = list(range(-1, n + 1))
    pair = [-1] * (n + 1)  # rank of the pair that starts at a position, -1 for none
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    summary = 0
    get = ranks.get
    for p in range(n - 1):
        r = get(piece[p : p + 2])
        if r is not None:
            pair[p] = r
            if r in buckets:
                buckets[r].append(p)  # ascending positions are a heap already
            else:
                buckets[r] = [p]
                leaf = r >> _LEAF_BITS
                leaves[leaf] = leaves.get(leaf, 0) | (1 << (r & _LEAF_MASK))
                summary |= 1 << leaf
    while summary:
        leaf = (summary & -summary).bit_length() - 1
        bits = leaves[leaf]
        rank = leaf << _LEAF_BITS | ((bits & -bits).bit_length() - 1)
        bucket = buckets[rank]
        lowest = rank
        while bucket and lowest >= rank:
            p = heappop(bucket)
            if pair[p] != rank:
                continue
            q = after[p]
            end = after[q]
            pair[q] = -1
            after[p] = end
            before[end] = p
            for at, stop in ((before[p], end), (p, after[end] if end < n else -1)):
                if at < 0:
                    continue
                r = get(piece[at:stop]) if stop > 0 else None
                if r is None:
                    pair[at] = -1
                    continue
                pair[at] = r
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    x = r >> _LEAF_BITS
                    leaves[x] = leaves.get(x, 0) | (1 << (r & _LEAF_MASK))
                    summary |= 1 << x
                if r < lowest:
                    lowest = r
        if not bucket:
            del buckets[rank]
            leaves[leaf] &= ~(1 << (rank & _LEAF_MASK))
            if not leaves[leaf]:
                summary &= ~(1 << leaf)
    out = []
    p = 0
    while p < n:
        out.append(ranks[piece[p : after[p]]])
        p = after[p]
    return out


class PairRanks:
    """Rank of a pair of adjacent tokens, by a sorted table of all splits of a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.stop = max(ranks.values()) + 1  # stands between pre-tokens and merges with nothing
        found = [
            (ranks[t[:i]] * (self.stop + 1) + ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        self.keys, self.values = table[:, 0].copy(), table[:, 1].copy()

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two tokens don't merge."""
        wanted = left * (self.stop + 1) + right
        if not len(self.keys):
            return np.full(len(wanted), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pair_ranks: PairRanks) -> list[np.ndarray]:
    """Token ids of many pre-tokens, which share one rank queue.

    The lowest rank of the whole queue is the lowest of every pre-token that has it, so all its merges are done
    together. Where a merge makes a pair that ranks before the merge itself, order inside the pre-token
    matters, and ``merge`` does that pre-token alone.
    """
    sizes = np.array([len(x) for x in pieces], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    flat = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", dtype=np.uint8)
    single = np.array([ranks.get(bytes([x]), -1) for x in range(256)], dtype=np.int64)
    token = single[flat]
    token[0] = token[starts + sizes] = pair_ranks.stop
    n = len(token)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[-1] = n - 1
    pair = np.full(n, -1, dtype=np.int64)
    pair[:-1] = pair_ranks(token[:-1], token[1:])
    odd: set[int] = set()
    buckets: dict[int, list[np.ndarray]] = {}
    leaves: dict[int, int] = {}
    summary = 0

    def push(at: np.ndarray) -> None:
        nonlocal summary
        rank = pair[at]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        firsts = np.concatenate(([0], cuts))
        for r, part in zip(rank[firsts].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if r in buckets:
                buckets[r].append(part)
            else:
                buckets[r] = [part]
                leaf = r >> _LEAF_BITS
                leaves[leaf] = leaves.get(leaf, 0) | (1 << (r & _LEAF_MASK))
                summary |= 1 << leaf

    found = np.flatnonzero(pair >= 0)
    if len(found):
        push(found)
    while summary:
        leaf = (summary & -summary).bit_length() - 1
        bits = leaves[leaf]
        low = (bits & -bits).bit_length() - 1
        rank = leaf << _LEAF_BITS | low
        leaves[leaf] = bits & ~(1 << low)
        if not leaves[leaf]:
            summary &= ~(1 << leaf)
        parts = buckets.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[pair[at] == rank]  # the others are stale
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1 and (chained := right[:-1] == at[1:]).any():
            # of overlapping pairs in a row, the first, third, fifth ... merge
            begins = np.concatenate(([True], ~chained))
            index = np.arange(len(at))
            keep = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at, right = at[keep], right[keep]
        end = after[right]
        token[at] = rank
        after[at] = end
        before[end] = at
        pair[right] = -1
        left = before[at]
        pair[at] = pair_ranks(token[at], token[end])
        pair[left] = pair_ranks(token[left], token[after[left]])
        touched = np.concatenate((at, left))
        made = pair[touched]
        touched = touched[made >= 0]
        if len(touched):
            if (early := pair[touched] <= rank).any():
                odd.update(np.searchsorted(starts, touched[early], side="right").tolist())
            push(touched)
    alive = after[before] == np.arange(n)  # a position lives if the one before it leads to it
    ids = token.astype("<i4")
    out = []
    ends = np.concatenate(([0], np.cumsum(alive)))
    ids = ids[alive]
    firsts, lasts = ends[starts].tolist(), ends[starts + sizes].tolist()
    for i, (piece, a, b) in enumerate(zip(pieces, firsts, lasts), 1):
        if piece in ranks or i in odd:
            out.append(np.asarray(merge(piece, ranks), dtype="<i4"))
        else:
            out.append(ids[a:b])
    return out


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.tokens[r] = token
        self.pair_ranks = PairRanks(self.ranks)
        self.split = regex.compile(pattern).findall
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """Parts of a text that are split and encoded on their own; all but the first lack their leading space.

        A single space between two characters that aren't white space always starts a pre-token, so the text is
        cut there; other spaces stay inside a part.
        """
        parts = text.split(" ")
        if parts[0] and parts[-1] and not _SPACES_MEET(text):
            return parts
        out, run = [], parts[0]
        for part in parts[1:]:
            if part and run and not part[0].isspace() and not run[-1].isspace():
                out.append(run)
                run = part
            else:
                run = f"{run} {part}"
        out.append(run)
        return out

    def learn(self, cuts: list[list[str]]) -> dict[str, bytes]:
        """Encode what the cache lacks of these cut texts, all of it in one queue; returns the first parts' ids."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        fresh: set[str] = set()
        for parts in cuts:
            fresh.update(parts)
        known = self.chunks
        split = {x: self.split(" " + x) for x in fresh if x not in known}
        heads = {x: self.split(x) for x in {parts[0] for parts in cuts}}
        pieces = list({y for found in (split, heads) for x in found.values() for y in x})
        coded: dict[str, bytes] = {}
        for at in range(0, len(pieces), 100_000):
            part = pieces[at : at + 100_000]
            made = merge_many([x.encode("utf-8") for x in part], self.ranks, self.pair_ranks)
            coded.update(zip(part, (x.tobytes() for x in made)))
        get, join = coded.__getitem__, b"".join
        for x, y in split.items():
            known[x] = get(y[0]) if len(y) == 1 else join(map(get, y))
        return {x: join(map(get, y)) for x, y in heads.items()}

    def encode_all(self, texts: list[str], step: int = 2_000_000) -> list[bytes]:
        """Ids of many texts as little-endian 32-bit integers; about ``step`` characters share one queue."""
        out: list[bytes] = []
        run: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            if run and (text is None or size + len(text) > step):
                heads = self.learn(run)
                chunk = self.chunks.__getitem__
                for first, *rest in run:
                    out.append(heads[first] + b"".join(map(chunk, rest)))
                run, size = [], 0
            if text is not None:
                run.append(self.cut(text))
                size += len(text)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def slices(texts: pa.Array, step: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Begins and ends of runs of rows of about ``step`` bytes; a row that ends beyond a multiple of it starts a run."""
    if not len(texts):
        return []
    sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()).to_numpy()
    ends = np.cumsum(sizes)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(ends // step)) + 1, [len(texts)])).tolist()
    return list(zip(starts[:-1], starts[1:]))


def encode_slice(texts: pa.Array, coder: Codec) -> pa.ListArray:
    """Ids of all rows; the Python strings of one run of rows at most are held."""
    held, sizes = [], [0]
    for at, stop in slices(texts):
        parts = coder.encode_all([x or "" for x in texts.slice(at, stop - at).to_pylist()])
        sizes += [len(x) // 4 for x in parts]
        held.append(b"".join(parts))
    values = pa.array(np.frombuffer(b"".join(held), dtype="<i4"), type=pa.int32())
    ends = pa.array(np.cumsum(sizes), type=pa.int32())
    return pa.ListArray.from_arrays(ends, values, type=pa.list_(pa.field("element", pa.int32(), nullable=False)))


def decode_slice(found: pa.ListArray, coder: Codec) -> pa.Array:
    """Bytes of all rows of ids."""
    ids, ends = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy()
    rows = zip(ends[:-1].tolist(), ends[1:].tolist())  # a null row has no ids either
    return pa.array([coder.decode(ids[a:b].tolist()) for a, b in rows], type=pa.binary())


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """``array<int>`` of the token ids of a text column; null and empty texts give an empty array."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        return encode_slice(texts, codec(rank_file, pattern))

    return ids.asNondeterministic()(text)  # keeps Spark from running the encoder again for each use of the ids


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """``binary`` of the bytes that an ``array<int>`` of ids stands for; null ids give no bytes."""

    @F.arrow_udf(T.BinaryType())
    def texts(found: pa.Array) -> pa.Array:
        return decode_slice(found, codec(rank_file, pattern))

    return texts.asNondeterministic()(ids)


def coded_batches(batches, rank_file: str, pattern: str):
    """Record batches of key, ids and decoded bytes, in slices of bounded size, of batches of key and text."""
    coder = codec(rank_file, pattern)
    for batch in batches:
        for at, stop in slices(batch.column(1)):
            part = batch.slice(at, stop - at)
            ids = encode_slice(part.column(1), coder)
            plain = ids.cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), plain, decode_slice(ids, coder)], names=["key", "ids", "bytes"])


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, bytes`` of every row: the key, the token ids and the bytes that they stand for. One Python worker a task does both."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    made = T.StructType().add("key", rows.schema["key"].dataType).add("ids", T.ArrayType(T.IntegerType())).add("bytes", T.BinaryType())
    return rows.mapInArrow(lambda batches: coded_batches(batches, rank_file, pattern), made)


def encode_column(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with one more column of token ids."""
    return docs.withColumn(out, encode(F.col(text).cast("string"), rank_file, pattern))


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of tokens, and SHA-256 digests of the ids and of the decoded bytes."""
    return round_trip(docs, rank_file, pattern, key, text).select(
        F.col("key").alias(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
