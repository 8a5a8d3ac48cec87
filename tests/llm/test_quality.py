import collections
import re

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm.queries import op2_quality

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nq", "é#*$ b|<> &% c", "w " * 5000, "a\x0bb\x0cc\rd", "k l m n k l m p k l m"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.statistics(df).collect():
        assert tuple(r[c] for c in COLS) == brute(texts[r.doc_id]), texts[r.doc_id]


def mcd_by_numpy(rows):
    """The same estimate for one unit, by numpy."""
    x = np.array([[r.x1, r.x2, r.x3, r.x4] for r in rows])
    floors = np.array(quality.FLOORS)
    wide = lambda s: quality.CONSISTENCY * s + np.diag(floors**2)
    far = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    med = np.array([np.sort(c)[(len(c) - 1) // 2] for c in x.T])
    u = (x - med) / np.sqrt((((x - med) / floors) ** 2).sum(axis=1))[:, None].clip(1e-300) * 2
    starts = [(med, np.diag(floors**2)), (x.mean(axis=0), wide(np.cov(x.T, bias=True))), (med, wide(u.T @ u / len(x)))]
    found = []
    for m, s in starts:
        for _ in range(quality.STEPS):
            bins = np.floor(16 * np.log(far(m, s) + 1e-6)).astype(int)
            part = x[bins <= np.sort(bins)[int(np.ceil(quality.SHARE * len(bins))) - 1]]
            m, s = part.mean(axis=0), wide(np.cov(part.T, bias=True))
        found.append((np.linalg.det(s), m, s))
    _, m, s = min(found, key=lambda f: f[0])
    return far(m, s)


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op2_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLS) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    full = quality.rate(docs)
    vector = quality.statistics(docs).selectExpr("doc_id", *[f"{v} as {k}" for k, v in quality.VECTOR.items()])
    units = collections.defaultdict(list)
    for r in full.filter("not base_failed").join(vector, "doc_id").collect():
        units[r.unit].append(r)
    assert len(units) > 3
    for rows in units.values():
        want = mcd_by_numpy(rows)
        assert np.allclose(want, [r.distance for r in rows], rtol=1e-6, atol=1e-9)
        assert [bool(d <= quality.CUT) for d in want] == [r.kept for r in rows]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    by = {(r.quality, r.kept): r.n for r in full.filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert by.get((1, False), 0) == 0 and by.get((0, True), 0) == 0


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, None, None), (None, good, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (3, good + " $#", "en", None), (3, good + " $#", "en", None), (4, "w " * 30000, "en", "a"), (5, "####### $$$$ " * 60, "en", "a")]
    df = spark.createDataFrame([(*r, True, 1.0) for r in rows], "doc_id int, text string, lang string, source string, kept boolean, distance double")
    assert quality.rate(df).count() == len(rows)
    left = quality.keep(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {1, None}
    assert quality.rate(df.limit(0)).count() == 0 and quality.keep(df.limit(0)).count() == 0


def test_shared_keys(spark):
    """A rejected text takes no other text along that has its key, null or not."""
    good = [" ".join(f"{p}{i}" for i in range(80)) for p in ("word", "term")]
    rows = [(k, t) for k in (None, 1) for t in (*good, "too short", None)]
    df = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id int, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.text) for r in quality.keep(df).collect()) == sorted((k, t) for k in (0, 1) for t in good)


def test_window_hashes_that_agree(spark):
    """Windows are told apart by their words where hashes agree, here always."""
    texts = ["a b c d e a b c", "x y z q x y z q r", "a a a a", "one two three four", "w1 w2 w3 w1 w2 w4 w1 w2 w3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    same = lambda *w: F.coalesce(F.length(w[0]) * 0, F.lit(0)).cast("long")
    got = df.select("doc_id", quality.repeated_words(F.split("text", " "), same).alias("n"), quality.repeated_words(F.split("text", " ")).alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in got} == {i: (brute(t)[4],) * 2 for i, t in enumerate(texts)}


def test_every_coordinate_rejects(spark):
    """A text that is odd in one statistic alone goes."""
    rnd = __import__("random").Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(3, 8))) for _ in range(n))
    rows = [(i, "\n".join(prose(30) for _ in range(6))) for i in range(200)]
    odd = {900: "\n".join("w" * 20 + x for x in prose(180).split()), 901: prose(150) + " #$%" * 60 + " " + prose(20), 902: prose(200) + "\nEND" * 30, 903: prose(520) + " " + " ".join([prose(240)] * 2)}
    df = spark.createDataFrame([(k, t, "en", "a") for k, t in [*rows, *odd.items()]], "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.rate(df).collect()}
    assert all(got[i].kept for i in range(200))
    assert [got[k].base_failed for k in odd] == [False] * 4 and [got[k].kept for k in odd] == [False] * 4, [(k, got[k].distance) for k in odd]
