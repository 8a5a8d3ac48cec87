"""Benchmark decontamination: item-sized windows that share a rare shingle, then exact weighted-shingle similarity. DataFrame functions only.

Words are runs of letters and digits in lower case; a shingle is five words (all of a shorter item's words) and
weighs as many as its characters. A window has as many words as a benchmark item, or is the whole text where that is shorter.

1. Seeds: places of a text whose shingle some item has. A window can only be similar to an item of its size if its
   seeds weigh ``num / den`` of the lightest such item; the others are left out, which loses nothing.
2. An item's index are its rarest shingles, as many as weigh more than ``1 - num / den`` of it. A window without any of them
   shares less than ``num / den`` of the item's weight and can't be similar, so a join on size and shingle finds all pairs.
3. These candidates are verified by the exact weighted Jaccard similarity.

Defined cases: null and empty texts, and items without words, match nothing; repeated rows have equal results; a null key
is a key like another; without benchmark items no text is contaminated; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.quality import let
from quern.session import settle

WIDTH = 5
#: Shingles of the benchmark up to which it is broadcast; beyond, the joins shuffle.
BROADCAST_SHINGLES = 1_000_000


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _words(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingles(words: Column, width) -> Column:
    """Array of ``h, w`` for each place where a shingle of ``width`` words starts."""
    size = F.size(words)

    def one(i: Column) -> Column:
        parts = [F.get(words, i + j) for j in range(width)]
        return F.struct(F.xxhash64(*parts).alias("h"), sum((F.length(x) for x in parts), F.lit(0)).alias("w"))

    return F.when(size >= width, F.transform(F.sequence(F.lit(0), F.greatest(size - width, F.lit(0))), one)).otherwise(
        F.array().cast("array<struct<h:bigint,w:int>>")
    )


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + x["w"])


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of distinct ``h, w``."""
    both = _weight(F.array_intersect(a, b))
    return both / (_weight(a) + _weight(b) - both).cast("double")


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Items with words: ``item, size`` (words), ``width``, distinct ``shingles`` and their ``weight``."""
    split = benchmark.select(F.col(item).alias("item"), F.struct(_words(F.col(text)).alias("words")).alias("s")).select("item", "s.words").filter(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WIDTH))
    arrays = F.coalesce(*[F.when(width == w, _shingles(F.col("words"), w)) for w in range(WIDTH, 0, -1)])
    made = split.select("item", F.size("words").alias("size"), width.alias("width"), F.array_distinct(arrays).alias("shingles"))
    return made.withColumn("weight", _weight(F.col("shingles")))


def index_of(items: DataFrame, num: int, den: int) -> DataFrame:
    """``item, size, other`` (its shingles), ``rare`` (the hashes of its rarest ones) and a row for each ``h`` of those."""
    each = items.select("item", "size", "weight", F.explode("shingles").alias("s")).select("item", "size", "weight", F.col("s.h").alias("h"), F.col("s.w").alias("w"))
    held = each.withColumn("n", F.count("*").over(Window.partitionBy("size", "h")))
    order = Window.partitionBy("item", "size", "weight").orderBy("n", F.desc("w"), "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(order), F.lit(0))
    needed = held.withColumn("before", before).filter(den * (F.col("weight") - F.col("before")) >= num * F.col("weight"))
    rare = needed.groupBy(F.col("item").alias("_i"), F.col("size").alias("_s"), F.col("weight").alias("_w")).agg(F.collect_set("h").alias("rare"))  # of one item
    same = F.col("item").eqNullSafe(F.col("_i")) & (F.col("size") == F.col("_s")) & (F.col("weight") == F.col("_w"))
    return items.join(rare, same).select("item", "size", F.col("shingles").alias("other"), "rare", F.explode("rare").alias("h"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", num: int = 8, den: int = 10) -> DataFrame:
    """``key, hash`` of a text, the ``item`` it holds, and ``similarity`` of the most similar window."""
    items = settle(items_of(benchmark, item, item_text), "items")
    seeds = items.select("size", "width", F.explode("shingles").alias("s")).select("size", "width", F.col("s.h").alias("h")).distinct()
    small = seeds.count() <= BROADCAST_SHINGLES
    lightest = items.groupBy("size", "width").agg(F.min("weight").alias("least"))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # five numbers at most
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))

    def places(words: Column) -> Column:
        each = [F.transform(_shingles(words, w), lambda x, i: F.struct(i.alias("at"), x["h"].alias("h"), x["w"].alias("w"), F.lit(w).alias("width"), F.size(words).alias("words"))) for w in widths]
        return F.concat(*each) if each else F.array().cast("array<struct<at:int,h:bigint,w:int,width:int,words:int>>")

    found = rows.select("key", "hash", F.explode(let(_words(F.col("text")), places)).alias("p")).select("key", "hash", "p.*")
    hits = settle(found.join(_small(seeds, small), ["h", "width"]).select("key", "hash", "size", "width", "words", "at", "w").distinct(), "hits")
    weighed = hits.groupBy("key", "hash", "size", "width", "words").agg(F.sum("w").alias("held"))
    able = weighed.join(_small(lightest, small), ["size", "width"]).filter(den * F.col("held") >= num * F.col("least")).drop("held")
    near = hits.select("key", "hash", "size", "at", "w").join(able.withColumnsRenamed({"key": "_k", "hash": "_h", "size": "_s"}), F.col("key").eqNullSafe(F.col("_k")) & (F.col("hash") == F.col("_h")) & (F.col("size") == F.col("_s"))).drop("_k", "_h", "_s")
    first = F.greatest(F.lit(0), F.col("at") - F.col("size") + F.col("width"))
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("words") - F.col("size")))
    starts = near.filter(first <= last).select("key", "hash", "size", "width", "least", "w", F.explode(F.sequence(first, last)).alias("start"))
    windows = starts.groupBy("key", "hash", "size", "width", "least", "start").agg(F.sum("w").alias("held")).filter(den * F.col("held") >= num * F.col("least"))
    listed = windows.groupBy("key", "hash").agg(F.collect_list(F.struct("size", "width", "start")).alias("windows"))  # of one text
    texts = rows.join(listed.withColumnsRenamed({"key": "_k", "hash": "_h"}), F.col("key").eqNullSafe(F.col("_k")) & (F.col("hash") == F.col("_h"))).dropDuplicates(["key", "hash"])

    def cut(words: Column) -> Column:
        def one(arrays: Column) -> Column:
            def window(x: Column) -> Column:
                part = F.slice(_of_width(arrays, x["width"]), x["start"] + 1, x["size"] - x["width"] + 1)
                return F.struct(x["size"].alias("size"), F.array_distinct(part).alias("shingles"))

            return F.transform(F.col("windows"), window)

        return let(F.struct(*[_shingles(words, w).alias(f"w{w}") for w in widths]), one)

    def _of_width(arrays: Column, width: Column) -> Column:
        return F.coalesce(*[F.when(width == w, arrays[f"w{w}"]) for w in widths])

    if not widths:
        return docs.sparkSession.createDataFrame([], f"key {dict(rows.dtypes)['key']}, hash long, item {dict(items.dtypes)['item']}, similarity double")
    cuts = texts.select("key", "hash", F.explode(let(_words(F.col("text")), cut)).alias("x")).select("key", "hash", "x.*")
    cuts = settle(cuts.distinct(), "windows")
    known = settle(index_of(items, num, den), "index")
    each = cuts.select("*", F.transform("shingles", lambda x: x["h"]).alias("held")).select("*", F.explode("held").alias("h"))
    # each pair once, at the first shingle of the window that is rare in the item
    pairs = each.join(_small(known, small), ["size", "h"]).filter(F.get(F.array_intersect("held", "rare"), F.lit(0)) == F.col("h"))
    judged = pairs.select("key", "hash", "item", _similarity(F.col("shingles"), F.col("other")).alias("similarity"))
    return judged.filter(F.col("similarity") >= num / den).groupBy("key", "hash", "item").agg(F.max("similarity").alias("similarity"))


def verdicts(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row per row of ``docs``: its key, ``contaminated``, the sorted ``item_ids`` it holds and the highest ``similarity``."""
    found = matches(docs, benchmark, key, text, **more)
    by_text = found.groupBy("key", "hash").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("similarity").alias("similarity"))
    by_text = by_text.withColumnsRenamed({"key": "_k", "hash": "_h"})
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_hash"))
    out = rows.join(by_text, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    return out.select(F.col("_key").alias(key), F.col("_h").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array()).alias("item_ids"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""
    found = matches(docs, benchmark, key, text, **more).select(F.col("key").alias("__quern_key"), F.col("hash").alias("__quern_hash")).distinct()
    hash_of = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(found, F.col(key).eqNullSafe(F.col("__quern_key")) & (hash_of == F.col("__quern_hash")), "left_anti")
