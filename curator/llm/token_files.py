"""Token ids in ORC files, in order of document ids.

Documents are dealt by ranges of their ids and sorted, so a file (shard) holds a range and the files' order is that of
the ids. A row holds up to ``PART`` ids of a document, as an integer list, which ORC writes by run-length encoding; longer documents
take several rows, so neither a writer nor a reader ever holds more than a batch of bounded rows. Stripes are read in parallel; each carries a row index
(least and greatest document id of every ``STRIDE`` rows) and a Bloom filter of document ids, so a lookup skips what can't hold them.
A second table has a row per shard: its documents, ids, range of document ids, and how many ids come before it. It is written
last, from the files themselves: a folder without it isn't whole.

Edge cases: null and empty texts hold the end id alone; a null document id comes first; rows that share an id are
ordered by the hash of their text, then as they were read; repeated rows are documents of their own; an empty table gives
files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordCoder, _file, _once
from .common import text_chunks
from .packing import piece_coders

#: Ids of a row at most, rows of an index entry, bytes of a stripe.
PART, STRIDE, STRIPE = 4096, 1000, 64 << 20

IDS = T.ArrayType(T.IntegerType())
ROW = [("shard", T.IntegerType()), ("row", T.LongType()), ("start", T.LongType()), ("part", T.IntegerType()), ("n", T.IntegerType())]


def text_coder(definition: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of whole texts as bytes: where most words are rare, one call for a text costs less than a look-up for each word. Vocabularies that only encode word by word keep to that."""
    slow, whole = piece_coders(definition, pattern)
    words = WordCoder(pattern, slow, whole)
    return lambda text: words.ids(text) if (ids := whole(text)) is None else ids


def _encoded(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int) -> DataFrame:
    """Rows of a task's documents in their order: shard, row, start (both within the shard), part, n, doc_id, ids."""
    raw = docs.sparkSession.sparkContext.broadcast(_file(docs.sparkSession, tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def make() -> Callable[[str], bytes]:
        return text_coder(raw.value.decode(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _once(("texts", tokenizer_path, pattern), make)
        shard, row, start = TaskContext.get().partitionId(), 0, 0
        for batch, texts in text_chunks(batches, "text"):
            places, rows, all_ids = [], [], []
            for i, text in enumerate(texts.to_pylist()):
                ids = coded(text) + end
                for part, lo in enumerate(range(0, len(ids), 4 * PART)):
                    own = ids[lo : lo + 4 * PART]
                    places.append(i)
                    rows.append((row, start, part, len(own) // 4))
                    all_ids.append(own)
                row += 1
                start += len(ids) // 4
            first, begins, parts, sizes = (np.array(c, np.int64) for c in zip(*rows))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(all_ids), "<i4")))
            columns = [pa.array(np.full(len(rows), shard, np.int32)), pa.array(first), pa.array(begins), pa.array(parts, pa.int32()), pa.array(sizes, pa.int32())]
            keys = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, keys, lists], names=[*(n for n, _ in ROW), "doc_id", "ids"])

    schema = T.StructType([*(T.StructField(n, t) for n, t in ROW), docs.schema["doc_id"], T.StructField("ids", IDS)])
    return docs.mapInArrow(run, schema)


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes path/tokens and path/shards; document ids are called doc_id there, whatever their column's name."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_first(), "_hash", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    tokens = _encoded(dealt, tokenizer_path, pattern, end_id)
    files = tokens.write.option("compression", "zstd").option("orc.stripe.size", STRIPE).option("orc.row.index.stride", STRIDE)
    files.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(f"{path}/tokens")
    found = spark.read.schema(tokens.schema).orc(f"{path}/tokens")
    shards = found.groupBy("shard").agg(
        F.countDistinct("row").alias("n_docs"), F.sum("n").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    shards.withColumn("before", F.coalesce(before, F.lit(0))).write.orc(f"{path}/shards")


def _read(spark: SparkSession, path: str, keys: list | None) -> tuple[DataFrame, DataFrame]:
    tokens, shards = spark.read.orc(f"{path}/tokens"), spark.read.orc(f"{path}/shards")
    if keys is not None:
        tokens = tokens.where(F.col("doc_id").isin(keys))
    return tokens, shards.select("shard", "before")


def read_token_ids(spark: SparkSession, path: str, keys: list | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of all documents, or of those with these ids: only stripes that may hold them are read."""
    tokens, shards = _read(spark, path, keys)
    whole = tokens.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return whole.join(shards, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.flatten("parts.ids").alias("ids"))


def joined_crc32(first: int, second: int, size: int) -> int:
    """crc32 of two byte strings in a row, from the crc32 of each and the size of the second: crc32 is linear but for its start."""
    zeros = b"\0" * size
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")).cast("B")
        at = np.concatenate([[0], np.cumsum(batch.column(4).to_numpy().astype(np.int64))]).tolist()
        sums = [zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "crc"])


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, [(part, n, crc)]) with the parts' sums joined."""
    for batch in batches:
        sums = []
        for parts in batch.column(3).to_pylist():
            total = parts[0]["crc"]
            for p in parts[1:]:
                total = joined_crc32(total, p["crc"], 4 * p["n"])
            sums.append(total)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str, keys: list | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, from the files."""
    tokens, shards = _read(spark, path, keys)
    kinds = {f.name: f for f in tokens.schema.fields}
    tokens = tokens.select(*(n for n, _ in ROW), "doc_id", "ids")
    schema = T.StructType([*(T.StructField(n, t) for n, t in ROW), kinds["doc_id"], T.StructField("crc", T.LongType())])
    parts = tokens.mapInArrow(_part_sums, schema)
    whole = parts.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts")
    )
    whole = whole.join(shards, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "parts")
    out = [kinds["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    return whole.mapInArrow(_document_sums, T.StructType(out))
