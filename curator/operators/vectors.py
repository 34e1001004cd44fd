"""Hashed n-gram vectors and similarity search over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The vector's length, the n-grams it is made of, and how much text a model that takes no more sees.
DIMENSIONS, SMALLEST, LARGEST, SEEN = 384, 2, 4, 1024
#: Items that a group of the search holds, about.
CHUNK = 20_000
#: Queries of a group whose cosines are in memory at once.
ROWS = 256
#: N-grams whose slots a task remembers, keys whose components it gives at once, and characters that it counts at once.
KNOWN, TOGETHER, PIECE = 500_000, 256, 1 << 20


def _chunk(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def hash_slot(gram: Column, dimensions: int = DIMENSIONS) -> Column:
    """struct<idx, sign> of the md5 of a text as a 128-bit number: its remainder, and the parity of its quotient."""
    digest = F.md5(gram.cast("binary"))
    m = 2 * dimensions
    rest = F.lit(0).cast("bigint")
    for i in range(4):  # 32 bits at a time
        rest = F.pmod(rest * F.lit(pow(2, 32, m)) + F.pmod(_chunk(digest, i), F.lit(m)), F.lit(m))
    return F.struct(F.pmod(rest, F.lit(dimensions)).cast("int").alias("idx"), F.when(rest < dimensions, 1).otherwise(-1).alias("sign"))


def hashed_ngrams(items: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS, most: int | None = SEEN) -> DataFrame:
    """(key, idx, value): the non-zero components of each text's vector, of length one. Texts of rows that share a key count together.

    most: characters of a text that count; None for whole texts. What is shuffled is that text, once; its n-grams, some
    three for each character, stay in the task that adds them up. Rows of a key follow each other, so a task holds the
    sums of one key at a time, and long texts are counted in pieces.
    """
    plain = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    seen = F.lower(plain if most is None else F.substring(plain, 1, most))
    rows = items.select(F.col(key).alias("_v_key"), seen.alias("_v_t")).repartition("_v_key").sortWithinPartitions("_v_key")
    kind = rows.schema["_v_key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _components(batches, dimensions), f"_v_key {kind}, idx int, value double").withColumnRenamed("_v_key", key)


def slot_of(gram: str, dimensions: int = DIMENSIONS) -> int:
    """hash_slot of one text: idx, or idx + dimensions where the sign is negative."""
    return int.from_bytes(hashlib.md5(gram.encode()).digest(), "big") % (2 * dimensions)


class _Slots(dict):
    """Slots of the n-grams seen so far."""

    def __missing__(self, gram: str) -> int:
        slot = self[gram] = slot_of(gram, self.dimensions)
        return slot


def _counted(pieces: list[str], slots: _Slots) -> np.ndarray:
    """The sums of each piece; its n-grams begin in its first PIECE characters."""
    dimensions, lengths = slots.dimensions, np.array([len(p) for p in pieces])
    joined = "".join(pieces)
    row, place = np.repeat(np.arange(len(pieces)), lengths), np.arange(len(joined))
    offset = place - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[row] - offset
    letters, alphabet = pd.factorize(np.frombuffer(joined.encode("utf-32-le"), np.uint32))
    both, names = np.zeros(len(pieces) * 2 * dimensions, np.int64), letters
    for n in range(2, LARGEST + 1):  # an n-gram is the one that is shorter by a character, and that character
        m = max(len(joined) - n + 1, 0)
        names, distinct = pd.factorize(names[:m] * (len(alphabet) + 1) + letters[n - 1 :])
        if n < SMALLEST:
            continue
        where = np.zeros(len(distinct), np.int64)
        where[names] = place[:m]
        slot = np.array([slots[joined[i : i + n]] for i in where.tolist()], np.int64)
        inside = (offset[:m] < PIECE) & (left[:m] >= n)
        both += np.bincount((row[:m] * (2 * dimensions) + slot[names])[inside], minlength=len(both))
    if len(slots) > KNOWN:
        slots.clear()
    both = both.reshape(len(pieces), 2 * dimensions)
    return both[:, :dimensions] - both[:, dimensions:]


def _sums(texts: pa.Array, slots: _Slots) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sums) of the pieces of all texts, in order."""
    places: list[int] = []
    pieces: list[str] = []
    size = 0
    for at, text in enumerate(texts):
        text = text.as_py() or ""
        for lo in range(0, max(len(text), 1), PIECE):
            piece = text[lo : lo + PIECE + LARGEST - 1]
            if pieces and (size + len(piece) > PIECE or len(pieces) >= TOGETHER):
                yield from zip(places, _counted(pieces, slots))
                places, pieces, size = [], [], 0
            places.append(at)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield from zip(places, _counted(pieces, slots))


def _components(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """The components of rows that are sorted by key."""
    slots = _Slots()
    slots.dimensions = dimensions
    last: tuple | None = None  # the key whose sums aren't complete yet
    sums = np.zeros(dimensions, np.int64)
    for batch in batches:
        keys, done = batch.column(0), []
        names = keys.to_pylist()
        for at, own in _sums(batch.column(1), slots):
            if last is not None and last[0] != names[at]:
                done.append((last[1], sums))
                sums = np.zeros(dimensions, np.int64)
            last = (names[at], keys.slice(at, 1))
            sums = sums + own
            if len(done) >= TOGETHER:
                yield _table(done, batch.schema.field(0).type)
                done = []
        if done:
            yield _table(done, batch.schema.field(0).type)
    if last is not None:
        yield _table([(last[1], sums)], last[1].type)


def _table(done: list[tuple[pa.Array, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    matrix = np.stack([sums for _, sums in done])
    norms = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
    row, idx = np.nonzero(matrix)
    keys = pa.concat_arrays([name for name, _ in done]).take(pa.array(row))
    return pa.RecordBatch.from_arrays([keys.cast(kind), pa.array(idx.astype(np.int32)), pa.array(matrix[row, idx] / norms[row])], ["_v_key", "idx", "value"])


def dense(components: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) from (key, idx, value)."""
    maps = components.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("_m"))
    return maps.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), F.lit(0.0))).alias("vector"))


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """(query, item, cosine, rank): the k most similar other items of each query, exactly.

    Queries are dealt to blocks of about `most`, items to chunks of about `CHUNK`; each pair of a block and a chunk is
    one group, which keeps k items for each of its queries, and the best of all chunks follow. So no pair of items is
    formed that isn't one of a stated query, and nothing goes to the driver but two counts. Vectors that are null or
    hold nulls, and vectors of different lengths, are never compared.
    """
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    asked = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    given = items.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    blocks, chunks = max(1, -(-asked.count() // most)), max(1, -(-given.count() // CHUNK))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(dealt(blocks).alias("block"), every(chunks).alias("chunk"), F.lit(True).alias("asks"), "id", "v")
    right = given.select(every(blocks).alias("block"), dealt(chunks).alias("chunk"), F.lit(False).alias("asks"), "id", "v")

    def best(table: pa.Table) -> pa.Table:
        asks, names = table["asks"].to_numpy(zero_copy_only=False), table["id"].to_numpy()
        vectors = table["v"].combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, ...]] = [(names[:0], names[:0], np.zeros(0))]
        for length in np.unique(lengths[asks]):
            rows = lambda side: np.flatnonzero((lengths == length) & (asks == side))  # noqa: B023, E731
            matrix = lambda at: vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(length))  # noqa: B023, E731
            unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            mine, theirs = rows(True), rows(False)
            parts = [mine[lo : lo + ROWS] for lo in range(0, len(mine), ROWS)]
            tops = [(np.zeros((len(p), 0), names.dtype), np.zeros((len(p), 0))) for p in parts]
            for lo in range(0, len(theirs), 2000):
                at = theirs[lo : lo + 2000]
                other = unit(matrix(at)).T
                for n, part in enumerate(parts):
                    cosine = unit(matrix(part)) @ other
                    cosine[names[part][:, None] == names[at][None, :]] = -np.inf
                    ids = np.concatenate([tops[n][0], np.broadcast_to(names[at], cosine.shape)], axis=1)
                    scores = np.concatenate([tops[n][1], cosine], axis=1)
                    order = np.lexsort((ids, -scores), axis=1)[:, :k]
                    tops[n] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            for part, (ids, scores) in zip(parts, tops):
                keep = np.isfinite(scores)
                out.append((np.broadcast_to(names[part][:, None], scores.shape)[keep], ids[keep], scores[keep]))
        return pa.table(dict(zip(("query", "item", "cosine"), map(np.concatenate, zip(*out)))))

    kind = items.schema[key].dataType.simpleString()
    found = left.unionByName(right).groupBy("block", "chunk").applyInArrow(best, f"query {kind}, item {kind}, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "item"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
