import re

from quern.llm import pii
from quern.llm.queries import op3_surrogates

ROWS = [
    (1, "Mail Anna.34@mail7.example.com or ANNA.34@MAIL7.EXAMPLE.COM; call +1 (017) 555-7713!"),
    (2, "again anna.34@mail7.example.com, +1 017 555-7713, card 3627072101032238 and 3627-0721-0103-2238."),
    (3, None),
    (4, ""),
    (5, "Mrs. Smith met Mr Smith and Frau Anna Schmidt; Mrs. SMITH left. Госпожа Иванова here"),
    (6, "host 10.1.2.3, 256.1.1.1, v1.2.3.4.5 and hex 04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    (6, "host 10.1.2.3, 256.1.1.1, v1.2.3.4.5 and hex 04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    (None, "odd \x01 mark b@c.de \x01"),
    (8, "word " * 20000 + "x@y.org"),
]


def run(spark, rows, key="k"):
    df = spark.createDataFrame([(k, t, "kept", 5) for k, t in rows], "doc_id long, text string, entity string, _map int")
    out = pii.pseudonymise(df, key, count="n")
    assert out.columns == ["doc_id", "text", "entity", "_map", "n"]
    return out.collect()


def test_mentions(spark):
    rows = run(spark, ROWS)
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r.text for r in rows}
    assert got[3] is None and got[4] == "" and got[8].startswith("word word") and "x@y.org" not in got[8]
    a, b = re.search(r"Mail (\S+) or (\S+); call (.*)!", got[1]).groups()[:2]
    assert b == a.upper() and "anna" not in a and re.search(r"\.\d\d@", a)
    assert a in got[2]
    digits = lambda s: re.sub(r"\D", "", s)
    phone1, phone2 = re.search(r"call (.*)!", got[1])[1], re.search(r"(\+\d \d{3} \d{3}-\d{4})", got[2])[1]
    assert digits(phone1) == digits(phone2) != "10175557713" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone1)
    card1, card2 = re.search(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4})\.", got[2]).groups()
    assert card1 == digits(card2) != "3627072101032238"
    m = re.match(r"Mrs\. (\w+) met Mr (\w+) and Frau (\w+) (\w+); Mrs\. (\w+) left\. Госпожа (\w+) here", got[5])
    assert m and m[1].endswith("na") and m[2] != m[1] and m[5] == m[1].upper() and m[3].endswith("na")
    assert re.fullmatch(r"[а-яА-Я]+", m[6])
    assert "10.1.2.3" not in got[6] and "256.1.1.1, v1.2.3.4.5 and hex 04dbebab91ab85687d33eeaaf9ac699e1188f962" in got[6]
    assert got[None].startswith("odd \x01 mark ") and got[None].endswith(" \x01") and "b@c" not in got[None]
    assert sorted(r.text or "" for r in run(spark, ROWS)) == sorted(r.text or "" for r in rows)
    assert {r.doc_id: r.text for r in run(spark, ROWS, "other")}[2] != got[2]


def test_collisions(spark, monkeypatch):
    """Two syllables make 64 family names, so some of 30 draws collide and are drawn again."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["a"] * 8 + ["b"] * 8)
    entities = spark.createDataFrame([(f"name:f x{chr(97 + i)}",) for i in range(26)], "entity string")
    got = pii.surrogates(entities, "k").collect()
    assert len(got) == 26 == len({r.surrogate for r in got}) == len({r.entity for r in got})


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_partial_names(spark):
    """A person named with a title is the same person where the text has the full name, the family name or another title."""
    text = "Mrs Anna Schmidt came. Mrs Schmidt's mail; Anna Schmidt, Dr. Anna Schmidt and SCHMIDT; Frau Dr. Schmidt. Mr Schmidt and Schmidtchen."
    rows = run(spark, [(1, text), (2, "Anna Schmidt has no title here"), (3, "call +1 (017) 555-7713"), (4, "call (017) 555-7713")])
    got = {r.doc_id: r.text for r in rows}
    m = re.fullmatch(r"Mrs (\w+) (\w+) came\. Mrs (\w+)'s mail; (\w+) (\w+), Dr\. (\w+) (\w+) and (\w+); Frau Dr\. (\w+)\. Mr (\w+) and Schmidtchen\.", got[1])
    assert m and m[1] == m[4] == m[6] != "Anna"
    assert m[2] == m[3] == m[5] == m[7] == m[9] != "Schmidt" and m[8] == m[2].upper() and m[10] not in (m[2], "Schmidt")
    assert got[2] == "Anna Schmidt has no title here"
    assert got[3] == "call +1 " + got[4][5:] and "555-7713" not in got[3]
    assert {r.doc_id: r.n for r in rows} == {1: 7, 2: 0, 3: 1, 4: 1}


def test_long_mentions(spark):
    """Addresses, names and titles of a megabyte."""
    texts = ["x@a" + ".a" * 500_000 + ".com", "Mr " + "A" * 1_000_000, "Mr " + "Dr. " * 200_000 + "Smith", "Mr A" + "'b" * 400_000, "a." * 500_000 + "@", "1" * 1_000_000, "+1" + " 22" * 300_000]
    got = {r.doc_id: r.text for r in run(spark, list(enumerate(texts)))}
    assert len(got) == len(texts) and got[0] != texts[0] and got[1] != texts[1] and not got[2].endswith("Smith") and got[5] == texts[5]


def test_types(spark):
    """Private addresses stay private, card numbers valid."""
    rows = run(spark, [(1, "10.0.0.5 and 192.168.1.9 and 172.20.0.1 but 8.8.4.4; card 4111 1111 1111 1111, not 4111 1111 1111 1112")])
    m = re.fullmatch(r"10(?:\.\d+){3} and 192\.168(?:\.\d+){2} and 172\.(\d+)(?:\.\d+){2} but (\d+)(?:\.\d+){3}; card (\d{4} \d{4} \d{4} \d{4}), not (\d{4} \d{4} \d{4} \d{4})", rows[0].text)
    assert m and 16 <= int(m[1]) < 32 and int(m[2]) >= 240
    total = lambda x: sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(x.replace(" ", "")))
    assert total(m[3]) % 10 == 0 and m[3] != "4111 1111 1111 1111"
    import hashlib
    import hmac

    got = spark.range(1).select(pii._keyed(pii.F.lit("entity|0"), "k" * 70).alias("h")).first().h
    assert got == hmac.new(b"k" * 70, b"entity|0", hashlib.sha256).hexdigest()


def test_exhausted_space(spark):
    """All two-digit numbers of a kind: draws widen until there is a free one for each."""
    entities = spark.createDataFrame([(f"phone:{i}",) for i in range(10, 20)], "entity string")
    got = pii.surrogates(entities, "k").collect()
    assert len(got) == 10 == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & {str(i) for i in range(10, 20)}


def test_query_leaves_nothing(spark, sf):
    """Every address and number of the corpus has one surrogate of its own, and none is left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{16}\b|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"
    new = {r.doc_id: r.text for r in op3_surrogates(spark, sf).collect()}
    pairs = set()
    for d in docs.collect():
        before, after = re.findall(found, d.text), re.findall(found, new[d.doc_id])
        assert len(before) == len(after)
        pairs |= {(a.lower(), b.lower()) for a, b in zip(before, after)}
        if not before and not re.search(r"[@\d]|M[rs]|Frau|Herr|Se|Sr|Mme|Mon|Mad|Miss", d.text):
            assert new[d.doc_id] == d.text
    assert len(pairs) > 5 and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    assert not {a for a, _ in pairs} & {b for _, b in pairs}
