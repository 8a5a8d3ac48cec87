import time

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import token_counts
from quern.llm.queries import op9_token_counts

FILE = P.path("word_bpe_49k.json")
TRUE = Tokenizer.from_file(FILE)
MINE = token_counts.counter(FILE)


def library(text):
    return len(TRUE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abetThSs'réß\n\t 12.,!  \x1c\x85漢🙂Σİé|<>"), max_size=50))
def test_like_library(text):
    assert MINE.count(text) == library(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("theranionS'réß 12.,!漢🙂"), max_size=40))
def test_every_prefix(text):
    plain = MINE.normalise(text)
    assert MINE.prefix_counts(text) == [library(plain[:k]) for k in range(len(plain) + 1)]
    for budget in (0, 1, 3, 7):
        counts = MINE.prefix_counts(text)
        assert MINE.cut(text, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_special_strings():
    for text in ("a<|endoftext|>b c", "<|startoftext|><|endoftext|>", "<|EndOfText|> x", "it<|end"):
        assert MINE.count(text) == library(text)


def test_rows(spark):
    rows = [(1, "The cat's  hat"), (2, None), (3, ""), (3, ""), (None, "x\n\n y"), (5, "ab" * 20000)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.token_budget(df, FILE, 10).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (str(k), len((t or "").encode()), library(t or ""), library(t or "") > 10) for k, t in rows
    )
    assert token_counts.token_budget(df.limit(0), FILE).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in op9_token_counts(spark, sf).collect()}
    assert got == {d.doc_id: library(d.text) for d in docs}


def test_unbroken_runs():
    """Every prefix of a long run, and a run of a million letters in seconds."""
    for run in ("ab'sThe" * 30, "漢字" * 60, "...!" * 40, "don'tdon't" * 9):
        plain = MINE.normalise(run)
        assert MINE.prefix_counts(run) == [library(plain[:k]) for k in range(len(plain) + 1)]
    letters = "".join("theraniongst"[i * i % 12] for i in range(1_000_000))
    start = time.time()
    at = MINE.cut(letters, 1000)
    assert time.time() - start < 30
    assert library(letters[:at]) <= 1000 < library(letters[: at + 1])
