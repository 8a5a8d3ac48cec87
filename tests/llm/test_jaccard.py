import collections
import random
import re

from quern.llm import jaccard
from quern.llm.queries import op1_ngram_jaccard


def brute(rows, width, num, den):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def check(spark, rows, width, num, den):
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, label int, token int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, width=width, num=num, den=den).collect()}
    assert got == brute(rows, width, num, den)


def made_up(seed, n, edits):
    """Groups of near copies with growing numbers of edits, of several lengths."""
    rnd = random.Random(seed)
    rows = []
    for size in (4, 9, 12, 30, 80, 200):
        base = [f"w{rnd.randrange(500)}" for _ in range(size)]
        for i in range(n):
            w = list(base)  # a text may lose all but one word
            for _ in range(rnd.randrange(edits + 1)):
                at = rnd.randrange(len(w))
                if len(w) == 1:
                    break
                w[at : at + 1] = rnd.choice([[], [f"x{rnd.randrange(90)}"], [w[at], "y"]])
            rows.append((len(rows), " ".join(w).title() if i % 3 else "\t".join(w)))
    return rows


def test_near_copies(spark):
    check(spark, made_up(1, 25, 4), 3, 90, 100)


def test_near_copies_five_words(spark):
    check(spark, made_up(2, 25, 6), 5, 8, 10)


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (3, text.upper()), (None, text), (7, None), (8, ""), (9, " \n "), (7, None), (10, "one two"), (11, "ONE two"), (12, "word " * 50000), (None, "alone here"), (5, text)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, id string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in jaccard.components(df).collect()), key=str)
    want = [(5, 3, 10), (5, 3, 10), (3, 3, 10), (None, 3, 10), (7, 7, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 10, 1), (11, 10, 1), (12, 12, 1), (None, None, 1)]
    assert got == sorted(want, key=str)
    left = jaccard.keep_first(df, width=3, num=90, den=100)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 7, 8, 9, 10, 12, None], key=str)
    assert jaccard.components(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_jaccard(spark, sf).collect()}
    assert got == brute([(d.doc_id, d.text) for d in docs], 3, 90, 100)


def copies(seed, n, words):
    """Copies of one text of 150 words with up to ten words changed."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(11)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(words)}"
        rows.append((i, " ".join(w)))
    return rows


def test_many_copies(spark):
    check(spark, copies(3, 300, 4) + [(1000 + k, t) for k, t in copies(4, 300, 10_000)], 3, 90, 100)


def test_repeated_key(spark):
    """Different texts with one key are judged by themselves."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, one), (1, two), (2, two), (3, "c " * 9)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.components(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id, r.text[:1]) for r in jaccard.keep_first(df).collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_shingles_are_counted_without_a_join(spark, monkeypatch):
    """A join of shingles with their counts made rows faster than the input grows, as chance sharing does, and shuffled each twice."""
    plans, settle = [], jaccard.settle

    def watched(df, name="step"):
        if name == "entries":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df, name)

    monkeypatch.setattr(jaccard, "settle", watched)
    same = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, same), (2, same + " end"), (3, "other words here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert len(plans) == 1 and not [x for x in plans[0].splitlines() if "Join" in x and re.search(r"\btoken#", x)]
