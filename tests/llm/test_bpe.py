import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe
from quern.llm.queries import op8_byte_bpe

FILE = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(bpe.codec(FILE, P.PATTERN).encode_all([text])[0], dtype="<i4").tolist() if text else []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe tTh'sréß\n\t 12.,!  \x1c漢🙂"), max_size=60))
def test_like_library(text):
    assert ids(text) == TRUE.encode_ordinary(text)


def test_one_queue_for_many_is_each_alone():
    import random

    rnd = random.Random(1)
    pieces = [bytes(rnd.choice(b"abtheion s") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    pieces += [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 30))) for _ in range(1000)]
    coder = bpe.codec(FILE, P.PATTERN)
    for piece, got in zip(pieces, bpe.merge_many(pieces, RANKS, coder.pair_ranks)):
        whole = RANKS.get(piece)
        assert got.tolist() == bpe.merge(piece, RANKS) == ([whole] if whole is not None else TRUE._encode_single_piece(piece))


def test_very_long_pre_tokens():
    for text in ("a" * 20000, "thetion" * 4000, "é" * 5000, " " * 9000 + "x", "\n" * 3000):
        assert ids(text) == TRUE.encode_ordinary(text)


def test_rows(spark):
    texts = [(1, "The cat's  hat"), (2, None), (3, ""), (3, ""), (None, "x\n\n y"), (5, "a" * 3000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.encode_digests(df, FILE, P.PATTERN).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts:
        e = TRUE.encode_ordinary(t or "")
        want.append((i, len(e), sha(" ".join(map(str, e)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(df.limit(0), FILE, P.PATTERN).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in op8_byte_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        e = TRUE.encode_ordinary(d.text)
        assert got[d.doc_id].n_tokens == len(e)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_slices_bound_what_a_worker_holds():
    import pyarrow as pa

    texts = ["word %d " % i * 40 for i in range(20_000)] + ["y" * 3_000_000, None, "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])
    made = list(bpe.coded_batches(iter([batch, batch.slice(5, 3), batch.slice(0, 0)]), FILE, P.PATTERN))
    held = [[len(y) for y in x.column(2).to_pylist()] for x in made]
    assert all(sum(x) - max(x) <= bpe.SLICE_BYTES for x in held) and len(made) > 5
    got = [x for part in made for x in zip(part.column(0).to_pylist(), part.column(2).to_pylist())]
    assert got == [(i, (t or "").encode()) for i, t in enumerate(texts)] + [(i, texts[i].encode()) for i in (5, 6, 7)]


def test_one_python_worker_a_task(spark, sf):
    """Encoding and decoding in two Python workers a task took twice the memory."""
    plan = op8_byte_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
