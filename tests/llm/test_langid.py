from pyspark.sql import functions as F

from quern.llm import langid
from quern.llm.queries import op6_language


def test_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op6_language(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "want")
    r = got.filter("doc_id is not null").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("want")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n == docs.count() and r.right > 0.95
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("want", F.regexp_extract("url", r"//[^/]+/(\w\w)/", 1)).filter("want != ''")
    r = got.filter("page_id is not null").join(pages, "page_id").agg(F.avg((F.col("lang") == F.col("want")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.right > 0.95


def test_signs_decide_short_texts(spark):
    train = spark.createDataFrame([("der und die mit nicht sich", "de")] * 30 + [("the and with not self", "en")] * 30, "text string, lang string")
    langs, logs = langid.learn(train)
    assert langs == ["de", "en"]
    rows = [(i, "https://a.beispiel.de/x", '<html lang="de"><p>der und die mit nicht</p>') for i in range(20)]
    rows += [(i, "https://b.example.com/x", '<html lang="en"><p>the and with not</p>') for i in range(20, 40)]
    rows += [(100, "https://a.beispiel.de/y", '<html lang="de"></html>'), (101, None, None), (102, "not an address", ""), (103, "https://b.example.com", "<p></p>"), (103, "https://b.example.com", "<p></p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")
    got = {r.id.page_id: (r.lang, r.probability) for r in langid.identify(langid.signs_of_pages(pages), langs, logs).collect()}
    assert got[100][0] == "de" and got[103][0] == "en" and got[5][0] == "de" and got[25][0] == "en"
    assert abs(got[101][1] - 0.5) < 0.1
    assert langid.identify(langid.signs_of_pages(pages.limit(0)), langs, logs).count() == 0
    assert langid.identify(langid.signs_of_pages(pages), *langid.learn(train.limit(0))).filter("lang is null").count() == len(rows)


def test_every_label_is_learned(spark):
    """A table with more than a hundred languages: the rarest of them is found too."""
    word = lambda i: "".join(chr(97 + (i * 7 + k * k * (i + 3)) % 26) for k in range(12))
    train = [(f"{word(i)} {word(i)[::-1]}", f"l{i:03}") for i in range(120) for _ in range(2)]
    train.append(("qqxzzx xqqzxq zzqxxz", "rare"))
    langs, logs = langid.learn(spark.createDataFrame(train, "text string, lang string"))
    assert len(langs) == 121 == len(logs)
    docs = spark.createDataFrame([(1, "qqxzzx xqqzxq zzqxxz", None)], "doc_id long, text string, source string")
    assert [r.lang for r in langid.identify(langid.signs_of_documents(docs), langs, logs).collect()] == ["rare"]


def test_declared_language_after_a_long_comment(spark):
    pages = spark.createDataFrame([(1, None, f"<!--{'x' * (1 << 20)}--><html lang='de'>")], "page_id long, url string, html string")
    assert langid.signs_of_pages(pages).first().declared == "de"
