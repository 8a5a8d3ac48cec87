"""Token counts by prefix dynamic programming, for a byte-level BPE with word ends.

For each prefix of a pre-token the program keeps the last token of its encoding and the number of tokens. A prefix ends
in token ``t`` exactly if ``t`` may follow the last token of what is left without ``t``, that is, if the two encoded together
stay the two; the pairs found so are remembered. With a count at every prefix, truncation to a budget needs no
second encoding: whole parts are added up, and inside the part where the budget ends the stored prefixes are looked up.

Prefixes are those of the normalised text (NFC, one space for white space, lower case by character).
Defined cases: null and empty texts count 0 tokens; the vocabulary's special strings inside a text are one token each,
as the library has it; a text without spaces costs time in proportion to its length; repeated rows have equal results; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each cache beyond which a Python worker drops it.
CACHE_ENTRIES = 500_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PrefixCounter:
    def __init__(self, file: str):
        import regex

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = frozenset(model["vocab"])
        merges = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.places = regex.compile(pattern).finditer
        parts = pattern.split("|")
        #: length of the longest fixed alternative, and what matches a run that one of the others takes whole
        self.short = max([0, *(len(x) for x in parts if not x.startswith("["))])
        self.runs = regex.compile(r"\p{L}+|[^\s\p{L}\p{N}]+").fullmatch if {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(parts) else None
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.letters = _byte_letters()
        self.longest = max(map(len, self.vocab))
        #: tokens that their own letters encode to; others are never in an encoding
        self.stands = frozenset(x for x in self.vocab if self.merged(self.symbols(x)) == [x])
        self.open = frozenset(x for x in self.stands if not (self.end and x.endswith(self.end)))
        self.follows: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() else "".join([c.lower() for c in text])

    def symbols(self, token: str) -> list[str]:
        """The letters of a token; an end of word belongs to the last."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1:] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The encoding of a few symbols, by the definition: the first pair of the lowest rank merges."""
        ranks, none = self.ranks, 1 << 30
        found = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while found and (least := min(found)) < none:
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def may_follow(self, last: str, token: str) -> bool:
        key = (last, token)
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > CACHE_ENTRIES:
                self.follows.clear()
            found = self.follows[key] = self.merged(self.symbols(last) + self.symbols(token)) == [last, token]
        return found

    def open_prefixes(self, word: str) -> tuple[list[str], list[int]]:
        """For each prefix of a word's letters, taken without an end of word: its last token, and how many tokens it has."""
        last, count = [""], [0]
        tokens, known, follow, longest = self.open, self.follows.get, self.may_follow, self.longest
        for j in range(1, len(word)):
            for i in range(j - longest if j > longest else 0, j):
                token = word[i:j]
                if token in tokens:
                    if i:
                        fits = known((last[i], token))
                        if not (follow(last[i], token) if fits is None else fits):
                            continue
                    last.append(token)
                    count.append(count[i] + 1)
                    break
        return last, count

    def closed(self, word: str, j: int, last: list[str], count: list[int]) -> int:
        """Tokens of the first ``j`` letters as a word of its own."""
        for i in range(max(0, j - self.longest), j):
            token = word[i:j] + self.end
            if token in self.stands and (i == 0 or self.may_follow(last[i], token)):
                return count[i] + 1
        raise ValueError(f"no encoding for {word!r}")

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHE_ENTRIES:
                self.words.clear()
            letters = self.spelled(word)
            found = self.words[word] = 1 if letters + self.end in self.stands else self.closed(letters, len(letters), *self.open_prefixes(letters))
        return found

    def spelled(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.letters.__getitem__, word.encode("utf-8")))

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of every prefix of one pre-token, by characters, from none to all."""
        letters = self.spelled(word)
        last, count = self.open_prefixes(letters)
        # in a run of one kind of characters every prefix is one pre-token, but for those as short as the fixed alternatives
        run = len(word) > self.short and self.runs is not None and self.runs(word) is not None
        out, j = [0], 0
        for k in range(1, len(word) + 1):
            j += len(word[k - 1].encode("utf-8"))
            parts = None if run and k > self.short else self.split(word[:k])
            out.append(self.closed(letters, j, last, count) if parts is None or len(parts) == 1 and len(parts[0]) == k else sum(map(self.word, parts)))
        return out

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without special strings."""
        found = self.chunks.get(chunk)
        if found is None:
            if len(self.chunks) > CACHE_ENTRIES:
                self.chunks.clear()
            found = self.chunks[chunk] = sum([self.word(x) for x in self.split(self.normalise(chunk))])
        return found

    def segments(self, text: str):
        """Parts of a text between special strings, and how many special tokens come before each."""
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def measured(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Pieces of a text (chunks between spaces, as pre-tokens never cross one, and special strings), the spaces before each, and its tokens."""
        if "<|" not in text:
            pieces = text.split(" ")
            return pieces, [0] + [1] * (len(pieces) - 1), list(map(self.chunk, pieces))
        pieces, gaps, sizes = [], [], []
        for part, special in self.segments(text):
            chunks = part.split(" ")
            pieces += chunks
            gaps += [0] + [1] * (len(chunks) - 1)
            sizes += map(self.chunk, chunks)
            if special is not None:
                pieces.append(special)
                gaps.append(0)
                sizes.append(1)
        return pieces, gaps, sizes

    def count(self, text: str) -> int:
        return sum(self.measured(text)[2])

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every prefix of the normalised text, which must hold no special string."""
        text = self.normalise(text)
        out = [0] * (len(text) + 1)
        done = at = 0
        for m in self.places(text):
            out[at : m.start() + 1] = [done] * (m.start() + 1 - at)
            inside = self.word_prefixes(m.group())
            out[m.start() : m.end() + 1] = [done + x for x in inside]
            done, at = done + inside[-1], m.end()
        out[at:] = [done] * (len(text) + 1 - at)
        return out

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of the normalised text that has at most ``budget`` tokens."""
        return self.cut_of(*self.measured(text), budget)

    def cut_of(self, pieces: list[str], gaps: list[int], sizes: list[int], budget: int) -> int:
        """``cut`` from the stored counts; only the piece in which the budget ends is looked into, at its prefixes' counts."""
        kept = done = 0
        for piece, gap, size in zip(pieces, gaps, sizes):
            if done + size > budget:
                if self.special.fullmatch(piece):
                    return kept
                return kept + gap + max(k for k, n in enumerate(self.prefix_counts(piece)) if done + n <= budget)
            done, kept = done + size, kept + gap + len(self.normalise(piece))
        return kept


@lru_cache(maxsize=2)
def counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def count_column(docs: DataFrame, file: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``cut_chars``, the characters of the normalised text that the budget holds."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("cut_chars", T.LongType())])

    @F.arrow_udf(kind)
    def counts(texts: pa.Array) -> pa.Array:
        counter_ = counter(file)
        n, cuts = [], []
        for x in texts:
            x = x.as_py() or ""
            found = counter_.measured(x)
            n.append(sum(found[2]))
            cuts.append(counter_.cut_of(*found, budget) if n[-1] > budget else len(counter_.normalise(x)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cuts, pa.int64())], ["n_tokens", "cut_chars"])

    made = docs.withColumn("_counts", counts.asNondeterministic()(F.col(text).cast("string")))
    return made.withColumns({"n_tokens": F.col("_counts.n_tokens"), "cut_chars": F.col("_counts.cut_chars")}).drop("_counts")


def token_budget(docs: DataFrame, file: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``cut_chars``."""
    slim = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    made = count_column(slim, file, limit, "_text")
    n_bytes = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    return made.select(key, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars")
