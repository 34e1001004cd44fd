"""Helpers that the training-data operators share: scratch tables, word windows, digests."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Most characters of text that a task turns into words at a time.
CHUNK_CHARS = 4_000_000


# ------------------------------------------------------------------ scratch
def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one if all runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("curator.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curator-")
        spark.conf.set("curator.scratch.dir", root)
    return root.rstrip("/")


_SCOPES = threading.local()


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that are written inside are removed at its end, but for those that kept() hands on."""
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        dropped(*stack.pop())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._curator_path = path
    if stack := getattr(_SCOPES, "stack", None):
        stack[-1].append(out)
    return out


def kept(df: DataFrame) -> DataFrame:
    """df as a table that outlives the scope it is written in; it belongs to the one around, if there is one."""
    out = written(df)
    if stack := getattr(_SCOPES, "stack", None):
        stack[-1].pop()
        if len(stack) > 1:
            stack[-2].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing will read again."""
    for table in tables:
        if path := getattr(table, "_curator_path", None):
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files give fewer tasks than there are: a text costs far more to read than to move. Large inputs stay as they are.

    Meant for tables: to tell its tasks, Spark runs the shuffles that df itself holds.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(name: str, df: DataFrame) -> str:
    """name, with as many underscores behind it as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -------------------------------------------------------------------- words
def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Arrow batches cut so that each holds a bounded number of characters (one long text may exceed it alone)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            continue
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // CHUNK_CHARS
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(texts)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts in one array, and where those of each text begin (n + 1 offsets)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if real.all():
        return flat, offsets
    kept = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), kept[offsets]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    codes = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(codes.dictionary))
    return own[codes.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash i covers items i to i + width - 1; the caller leaves out those that cross a text's end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        factor = xxhash.xxh3_64_intdigest(f"curator window {j}".encode()) | 1
        total += hashes[j : j + n] * np.uint64(factor)
    return mixed(total)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers starts[i] .. starts[i] + lengths[i] - 1 of every i, in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
