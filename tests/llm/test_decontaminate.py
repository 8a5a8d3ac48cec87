import random

import regex

from quern.llm import decontaminate


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(w, width):
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def weight(s):
    return sum(len(x) for t in s for x in t)


def brute(docs, items, least=0.8):
    out = {}
    for k, text in docs:
        w = words(text)
        held = set()
        for i, other in items:
            o = words(other)
            if not o:
                continue
            width = min(5, len(o))
            b = shingles(o, width)
            if not shingles(w, width) & b:
                continue
            for s in range(max(1, len(w) - len(o) + 1)):
                a = shingles(w[s : s + len(o)], width)
                both = weight(a & b)
                if both >= least * (weight(a) + weight(b) - both) and both:
                    held.add(i)
                    break
        out[k] = sorted(held)
    return out


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {r.doc_id: r.item_ids for r in decontaminate.verdicts(docs, items).collect()}
    assert got == want and any(want.values())


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, f"Before. {item.upper()}; after"),
        (2, item.replace("twelve", "12").replace("one ", "uno ")),
        (3, None),
        (4, ""),
        (5, "tiny Item"),
        (6, item),
        (6, item),
        (None, item),
        (8, "one two three four"),
        (9, "word " * 30000 + item),
    ]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "..."), (5, item)], "item_id long, text string")
    want = brute(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = decontaminate.verdicts(docs, bench).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.item_ids for r in got} == want
    assert want[1] == [1, 5] and want[5] == [2]
    left = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, v in want.items() if not v)
    assert left.columns == docs.columns
    assert decontaminate.verdicts(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.verdicts(docs.limit(0), bench).count() == 0


def test_unequal_words(spark):
    """One long word of an item outweighs the others; windows that lack another word of it are still found."""
    dice = random.Random(5)
    word = lambda n: "".join(dice.choice("abcdefghijklmnop") for _ in range(n))
    rows, bench = [], []
    for i in range(16):
        w = [word(5) for _ in range(200)]
        w[60], w[140] = word((128, 200)[i % 2]), word((128, 60)[i % 2])
        bench.append((i, " ".join(w)))
        w[(60, 140)[i // 2 % 2]] = word(5)
        rows.append((i, f"{word(7)} {' '.join(w)} {word(6)}"))
    want = brute(rows, bench)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate.verdicts(docs, items).collect()} == want
    assert sum(map(bool, want.values())) > 4
