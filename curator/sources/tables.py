"""Tables of a data folder, and the curation tables as views over them.

``documents`` stands for news: the first line is no title there, so its first 60 characters are; the time of
publication is derived from the id. ``labels`` stands for expert reviews, ``events`` for notifications and clicks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files give fewer tasks than there are: where a row costs far more to compute than to move. Large inputs stay as they are.

    Meant for tables: to tell its tasks, Spark runs the shuffles that df itself holds.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.expr("make_dt_interval(0, 0, cast((doc_id * 2711) % 43200 as int), 0)")
    status = F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'queued_today' ELSE 'none' END")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("lang").alias("category"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        (F.col("n_chars") / F.lit(20000.0)).alias("importance"), (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + minutes).alias("published_at"), status.alias("status"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("CASE WHEN toxic = 1 THEN 'discarded' WHEN quality = 1 THEN 'published' ELSE 'draft' END")
    comment = F.expr("CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('quality ', quality) END")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("news_id"), state.alias("publish_status"), comment.alias("expert_comment"), (F.col("doc_id") % 17 == 0).alias("opinion_conflict"),
        (F.expr("timestamp_ntz'2024-01-02 00:00:00'") + F.expr("make_dt_interval(0, 0, cast((doc_id * 2711) % 43200 as int), 0)")).alias("reviewed_at"),
    )


#: The same views for DuckDB.
NEWS_SQL = """news AS (
    SELECT doc_id AS id, source, lang AS category, substr(text, 1, 60) AS title, text AS content, n_chars / 20000.0::DOUBLE AS importance,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((doc_id * 2711) % 43200)::INT) AS published_at,
        CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'queued_today' ELSE 'none' END AS status
    FROM documents)"""
REVIEWS_SQL = """reviews AS (
    SELECT doc_id AS news_id, CASE WHEN toxic = 1 THEN 'discarded' WHEN quality = 1 THEN 'published' ELSE 'draft' END AS publish_status,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'quality ' || quality END AS expert_comment, doc_id % 17 = 0 AS opinion_conflict,
        TIMESTAMP '2024-01-02 00:00:00' + to_minutes(((doc_id * 2711) % 43200)::INT) AS reviewed_at
    FROM labels)"""
