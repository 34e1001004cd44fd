"""An index of the keys a stream has kept, of which a batch reads only what it may hit.

Keys are digests, dealt to parts by their first bits. Each batch adds to the parts of its new keys a file of them and,
beside it, a Bloom filter. A batch first reads the filters of its own keys' parts, then the key files of those parts alone in which a
filter tells it may find one. So what a batch reads grows with the batch and with its parts, not with all that was ever
kept; ``regrown`` deals the keys to more parts once these have become large.

A batch that runs again after a failure replaces what it wrote and doesn't see itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each key, and how many of them a key sets: about one key in a hundred seems to be there and isn't.
BITS_PER_KEY, PROBES = 10, 7


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _spots(digests: list[str], size: int) -> np.ndarray:
    """The bits that hexadecimal digests of SHA-256 set in a filter of so many, a row for each digest: its last words, as the first bits choose its part."""
    raw = np.frombuffer(b"".join(map(bytes.fromhex, digests)), ">u4").reshape(len(digests), -1)
    return raw[:, -PROBES:].astype(np.int64) % size


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, digest) in order of prefixes: (prefix, n, bits) of each."""
    prefix, held, rows = None, [], []

    def done() -> None:
        size = max(64, BITS_PER_KEY * len(held))
        bits = np.zeros(size, bool)
        bits[_spots(held, size).ravel()] = True
        rows.append((prefix, len(held), size, np.packbits(bits).tobytes()))

    for batch in batches:
        for p, digest in zip(*(c.to_pylist() for c in batch.columns)):
            if p != prefix and held:
                done()
                held = []
            prefix = p
            held.append(digest)
    if held:
        done()
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["prefix", "n", "size", "bits"])


def _may_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, digest, size, bits): the prefixes whose filter may hold the digest."""
    for batch in batches:
        out = []
        for prefix, digest, size, bits in zip(*(c.to_pylist() for c in batch.columns)):
            spots = _spots([digest], size)[0]
            if all(bits[s >> 3] >> (7 - (s & 7)) & 1 for s in spots.tolist()):
                out.append(prefix)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(out)), pa.int32())], names=["prefix"])


class KeyIndex:
    """Below a folder: keys/prefix=/batch= and filters/prefix=/batch=."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 12):
        self.spark, self.path, self.bits = spark, path.rstrip("/"), bits

    def prefix(self, digest: Column) -> Column:
        """The first bits of a hexadecimal digest, as many as the index has; at most 2^16 parts."""
        return F.shiftright(F.conv(F.left(digest, F.lit(4)), 16, 10).cast("int"), 16 - self.bits)

    def _part(self, kind: str, prefixes: list[int], number: int) -> DataFrame | None:
        """Files of these parts but for the batch's own; None if there are none. Only their folders are listed."""
        base = f"{self.path}/{kind}"
        paths = [p for p in (f"{base}/prefix={i}" for i in prefixes) if _exists(self.spark, p)]
        if not paths:
            return None
        schema = {"keys": "digest string, prefix int, batch bigint", "filters": "n bigint, size bigint, bits binary, prefix int, batch bigint"}[kind]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).where(F.col("batch") != number)

    def candidates(self, digests: DataFrame, number: int) -> DataFrame:
        """Kept keys (digest) among which are all of these digests that were kept before this batch."""
        own = digests.select(self.prefix(F.col("digest")).alias("prefix"), "digest")
        touched = [r[0] for r in own.select("prefix").distinct().collect()]  # as many as parts at most
        filters = self._part("filters", touched, number)
        if filters is None:
            return self.spark.createDataFrame([], "digest string")
        tested = own.join(filters.select("prefix", "size", "bits"), "prefix").select("prefix", "digest", "size", "bits")
        hit = [r[0] for r in tested.mapInArrow(_may_hold, "prefix int").distinct().collect()]
        keys = self._part("keys", hit, number)
        return self.spark.createDataFrame([], "digest string") if keys is None else keys.select("digest")

    def add(self, digests: DataFrame, number: int) -> None:
        """Keeps these digests, each there once, as the batch's."""
        own = digests.select(self.prefix(F.col("digest")).alias("prefix"), "digest").repartition("prefix").sortWithinPartitions("prefix", "digest")
        for kind, rows in (("keys", own), ("filters", own.mapInArrow(_filters, "prefix int, n bigint, size bigint, bits binary"))):
            out = rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("prefix", "batch").parquet(f"{self.path}/{kind}")

    def regrown(self, path: str, bits: int) -> KeyIndex:
        """The same keys below another folder, dealt to as many parts as these bits tell, in one file each. They count as of batch -1."""
        other = KeyIndex(self.spark, path, bits)
        if _exists(self.spark, f"{self.path}/keys"):
            other.add(self.spark.read.parquet(f"{self.path}/keys").select("digest"), -1)
        return other


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that a plan reads."""
    spark, total = df.sparkSession, 0
    for file in df.inputFiles():
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
    return total
