"""Incremental jobs: each run takes what is new (availableNow) and appends to a table; reading rolls up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edition
from ..operators.state import insert_or_ignore
from ..sources.scratch import root
from .index import KeyIndex


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def arrivals(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of a table's files, whether it is one file or a folder of them."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = _files(spark, path).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_edition_counts(events: DataFrame, target: str, checkpoint: str, lateness: str = "2 days") -> None:
    """Appends, for each batch, counts and sums by day and edition; an event id counts once within the lateness allowed.

    Events later than that are counted too, but a repeat of theirs isn't told apart any more.
    """
    timed = events.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", lateness).dropDuplicatesWithinWatermark(["event_id"])
    keyed = timed.select(F.to_date("ts").alias("day"), edition(F.col("ts")).alias("edition"), "value")

    def append(batch: DataFrame, number: int) -> None:
        batch.groupBy("day", "edition").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = keyed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rolled_up(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("day", "edition").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def run_ingest(arriving: DataFrame, target: str, checkpoint: str, key: str, order: str, bits: int = 12) -> None:
    """Appends rows whose key (a hexadecimal SHA-256) isn't in the target yet, first come first kept; a batch that runs again replaces itself.

    Kept keys are in an index beside the target, so a batch reads the parts of it that it may hit, not the target.
    """

    def append(batch: DataFrame, number: int) -> None:
        index = KeyIndex(batch.sparkSession, f"{target}-keys", bits)
        known = index.candidates(batch.select(F.col(key).alias("digest")).where(F.col(key).isNotNull()), number)
        new = insert_or_ignore(known.select(F.col("digest").alias(key)), batch, key, [F.col(order)])
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        kept = batch.sparkSession.read.schema(new.schema).parquet(f"{target}/batch={number}")
        index.add(kept.select(F.col(key).alias("digest")).where(F.col(key).isNotNull()), number)

    query = arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def folders(spark: SparkSession) -> tuple[str, str]:
    """A new target and checkpoint in the shared folder."""
    base = f"{root(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"
