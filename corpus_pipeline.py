"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, PII and packing, each over all its predecessor kept.

Every stage takes and returns the columns of documents (the last one returns pieces). Null texts count as empty; rows
that repeat are copies, of which one stays; an empty table gives empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curator.llm.common import dropped, scratch_root, scratch_scope, table, unused, written
from curator.llm.line_dedup import dedup_lines
from curator.llm.ngram_join import ngram_jaccard
from curator.llm.packing import pack
from curator.llm.pii import pseudonymise
from curator.llm.quality_rules import filter_quality
from curator.llm.queries import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do the lines above the limit of those that stay.

    A null or empty text is rejected; a null source is a host of its own; rows that repeat stay or go together.
    """
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing stays goes with them.

    Texts of fewer than three lines, empty and null ones stay as they are; of rows that share an id neither is a repeat of the other.
    """
    out = dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one of least id stays (of several with that id, by a digest of their texts).

    A document is an id and a text: rows that share an id are decided one by one, each by its own text. Rows that agree in
    both are repeats, of which the least by their other columns stays. Documents without an id come after all others.
    """
    key, first, times = unused("_key", docs), unused("_first", docs), unused("_times", docs)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("digest"))
    keyed = docs.withColumn(key, own)
    found = ngram_jaccard(keyed, key=key)
    found = found.groupBy(F.col(key).alias(first)).agg(F.count(F.lit(1)).alias(times), F.min("component_id").alias("_c")).where(F.col(first) == F.col("_c"))
    keys = written(found.select(first, times))
    once = keyed.join(keys.where(F.col(times) == 1), F.col(key) == F.col(first), "left_semi").drop(key)
    again = keyed.join(keys.where(F.col(times) > 1), F.col(key) == F.col(first), "left_semi")
    again = again.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias(first)).select(f"{first}.*")
    return once.unionByName(again)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; null texts stay null, rows that repeat get equal texts."""
    return pseudonymise(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is the end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("pii", private), ("packing", packed)]

#: SQL can't express Feistel permutations or the packing of a histogram.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch_scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        dropped(docs)  # a stage's table goes when the next one's is whole; the given documents are no scratch table
        docs = spark.read.parquet(path)
        docs._curator_path = path
    return docs
