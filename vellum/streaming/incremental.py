"""Incremental index build: new paragraphs merged by their id, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import search
from vellum.operators.index import SearchIndex


def upsert(spark: SparkSession, target: str, batch: DataFrame, key: str, epoch: int) -> None:
    """Appends a batch, the last row of each key in it, under its epoch; a batch that runs again replaces itself, so a retry changes nothing."""
    one = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in batch.columns if c != key) or [key]))).where("_r = 1").drop("_r")
    one.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The latest row of each key."""
    rows = spark.read.parquet(target)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("epoch")))).where("_r = 1").drop("_r", "epoch")


def compact(spark: SparkSession, target: str, key: str, compacted: str) -> DataFrame:
    """Writes the latest row of each key to a new target under the last epoch, so that epochs do not pile up; later batches go there."""
    last = spark.read.parquet(target).agg(F.max("epoch")).first()[0]
    current(spark, target, key).withColumn("epoch", F.lit(last)).write.mode("overwrite").partitionBy("epoch").parquet(compacted)
    return spark.read.parquet(compacted)


def build(rows: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """rows: a streaming frame of paragraphs."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, epoch: upsert(b.sparkSession, target, b, key, epoch)).start()


def build_index(rows: DataFrame, path: str, key: str, order: str, checkpoint: str, deleted: str | None = None, name: str = "stream", most_segments: int = 8, tokenizer=search.ordered_tokens) -> StreamingQuery:
    """rows: a streaming frame of points, into the search index in `path`, a segment a batch. Of a key's rows in a batch the last by `order` holds;
    where its column `deleted` is true, the point goes. A batch that runs again after a failure finds its epoch applied. Segments are put together beyond `most_segments`."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        SearchIndex(batch.sparkSession, path, tokenizer).upsert(last.where(~gone), last.where(gone), epoch=(name, epoch)).compact(most_segments)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
