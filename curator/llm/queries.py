"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, line_dedup, ngram_join, prefix_trie, spelling, substring_dedup
from . import quality_rules as quality
from .bpe import decode_bpe, encode_bpe, id_count
from .common import scratch_root, table
from .embedding_dedup import embedding_near_dedup
from .html_extract import extract_text
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard
from .packing import pack
from .pii import pseudonymise
from .prefix_trie import conversation_trie
from .quality_rules import COUNTS, quality_rules
from .spelling import spelling_variants, vocabulary
from .substring_dedup import remove_repeats
from .token_files import token_digests, write_token_ids
from .toxicity import learn, score


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), n=5, percent=80)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, width=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"), sample=20_000), threshold=0.3)


#: The pseudonyms' key in these queries; a real one is a secret of whoever runs them.
PII_KEY = "curator"


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_bpe(docs, ranks, public_tokenizers.PATTERN).drop("text")
    decoded = decode_bpe(encoded, ranks)
    return decoded.select("doc_id", id_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), least_length=6, least_count=5, remove_every=199), ratio=5)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), group=100, kinds=6)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return token_digests(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_ngram_join, op4_bpe, op5_embedding_dedup, op6_pii, op7_line_dedup, op8_html_extraction, op9_quality_rules, op10_substring_dedup, op11_spelling, op12_prefix_trie, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    """The others can't be told in SQL: tokens, packing, learned weights, Feistel networks and trees are tested by brute force."""
    return {
        "op3_ngram_join": ngram_join.ORACLE_SQL,
        "op5_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op9_quality_rules": quality.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_spelling": spelling.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    }
