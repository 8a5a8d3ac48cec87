from pyspark.sql import functions as F

from quern.llm import toxicity
from quern.llm.queries import op5_toxicity


def test_folding():
    assert toxicity.fold("Тr4sh, 1d10t!") .split() == ["trash", "idiot"]
    assert toxicity.fold("st@pl$x").split() == ["staplsx"]
    for odd in ("ｔｒａｓｈ", "𝐭𝐫𝐚𝐬𝐡", "tràsh", "tra\u200bsh", "tr4$h", "TRA\u00adSH", "тrаѕһ"):
        assert toxicity.fold(odd).split() == ["trash"], odd
    assert toxicity.fold("$ink a$$ 100$ $5").split()[:2] == ["sink", "ass"]


def test_exceptions_and_length():
    s = toxicity.Scorer({" clown ": 2.0, " clo": 1.0}, ("clown fish",))
    assert s("a clown fish")[1] == 0
    assert s("a clown")[1] == 1 and s("a clown")[0] > s("a clown " + "word " * 200)[0]
    assert s("")[0] == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 500 and r.right > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "x", 1.0), (3, "bad word " * 9000, 1.0), (3, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score(docs, known).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_learned_exceptions(spark):
    """An entry that is harmless before a certain word doesn't count there."""
    toxic = [(f"you vile clown {i} go away now", 1) for i in range(60)]
    fine = [(f"a clown fish swims {i} here", 0) for i in range(20)] + [(f"plain words {i} there", 0) for i in range(1000)]
    train = spark.createDataFrame(toxic + fine, "text string, toxic int")
    weights, texts = toxicity.learn_lexicon(train)
    safe = toxicity.learn_exceptions(train, weights, texts)
    assert " clown " in weights and "clown fish" in safe and "vile clown" not in safe
    s = toxicity.Scorer(weights, safe)
    assert s("the clown fish")[0] == 0 < s("the clown")[0]
