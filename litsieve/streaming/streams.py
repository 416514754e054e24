"""Structured Streaming forms of the record-at-a-time surfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import doi_stem
from ..schema import PAPER
from ..storage import new_path


def papers_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    return spark.readStream.schema(PAPER).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_seen(stream: DataFrame, doi: str = "doi") -> DataFrame:
    """Each DOI once; rows without a DOI all pass."""
    keyed = stream.withColumn("_key", F.coalesce(doi_stem(F.col(doi)), F.concat(F.lit("row:"), F.col("id"))))
    return keyed.dropDuplicates(["_key"]).drop("_key")


def only_new(stream: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that aren't in the output yet (a stream-static anti join)."""
    return stream.join(done.select(key), key, "left_anti")


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def running_mean(stream: DataFrame, by: str, value: str) -> DataFrame:
    """(sum, count) state by key, read as a mean."""
    return stream.groupBy(by).agg(F.sum(value).alias("total"), F.count(value).alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def to_files(stream: DataFrame, folder: str, checkpoint: str, kind: str = "json"):
    return stream.writeStream.format(kind).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Exactly-once upserts: the step is given each micro-batch with its number."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder: appended
    batch by batch, or (complete) the last state."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    if mode == "append":
        query = to_files(stream, path, checkpoint, "parquet")
    else:
        query = each_batch(stream, lambda batch, _: batch.write.mode("overwrite").parquet(path), checkpoint, mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def with_ttl(stream: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """The first row of each key within a time to live: state older than that is dropped, and
    a key that comes again after it passes anew."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def update_centroid(batch: DataFrame, folder: str, vector: str, side: str) -> DataFrame:
    """Session state across runs: sums and counts by side and position are added to what the
    folder holds as a new generation; returns the means so far."""
    spark = batch.sparkSession
    fresh = batch.select(side, F.posexplode(vector).alias("pos", "x")).groupBy(side, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("x").alias("n"))
    fresh.write.mode("append").parquet(folder)
    every = spark.read.schema(fresh.schema).parquet(folder).groupBy(side, "pos").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return every.groupBy(side).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("mean_vector"))
