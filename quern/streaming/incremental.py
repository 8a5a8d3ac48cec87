"""Streams of facts: rules over each batch of new facts, and windowed correlation of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import new_path


def derive(stream: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str, key: list[str]):
    """A streaming query that keeps a rule's conclusions up to date as facts arrive. ``rule(new, all)`` gives what a batch's facts lead
    to together with all facts so far. Facts and conclusions are kept as Parquet under ``out``, a folder a batch, so that a batch that
    runs twice after a failure replaces itself."""

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        facts = spark.read.parquet(f"{out}/facts").filter(F.col("batch") <= number).drop("batch")
        found = rule(spark.read.parquet(f"{out}/facts/batch={number}"), facts).distinct()
        if number:
            found = found.join(spark.read.parquet(f"{out}/found").filter(F.col("batch") < number), key, "left_anti")
        found.write.mode("overwrite").parquet(f"{out}/found/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, table: DataFrame, parts: int, key: str) -> str:
    """Write a table as ``parts`` files of a folder, for a stream to read one after the other."""
    path = new_path(spark, "stream")
    table.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).repartition(parts, "part").drop("part").write.parquet(path)
    return path


def windowed_counts(events: DataFrame, at: str, by: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows; on a stream, rows that come later than ``late`` are left out."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    made = stamped.groupBy(F.window("_at", width), by).agg(F.count("*").alias("n_events"), F.sum(value).alias("total"))
    return made.select(F.col("window.start").alias("window_start"), by, "n_events", "total")
