"""Embedding near-dedup: sorted projection passes.

Every pass hashes each vector by the signs of its projections on random directions, 64 bits one after the other, and
orders all vectors by that string. Vectors at a small angle share long prefixes, so each is compared with a bounded
window of neighbours in the order; pairs whose cosine, in double precision, reaches the threshold are links. Orders
are cut into ranges by hash and id, so a crowd of like vectors is spread over tasks like any other rows; rows next to
a cut are compared again with those beyond it. Links of all passes are united into components. A window bounds how many
neighbours a pass can show; the rest are found exactly: within a component all pairs are compared in square blocks of
bounded size, and only counts leave a block.

Passes come in rounds, as many as the table needs. A pass shows a vector any other that shares the first b bits of its
string, where b is the least number of bits that no more rows share with it than fit the window on either side; a
vector at the threshold's angle does so with a probability of (1 - angle / pi) ** b. So each vector's probability to
have missed such a link in all passes is known from the orders themselves. Rounds go on until its mean is at most
``miss``, over the vectors that aren't yet in a component larger than the window: between a crowd and another vector, the
other's probability holds.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; equal vectors are
one class and are not paired; a null key is never a component's id unless all its members' are; repeated rows are
copies; vectors of different lengths are never compared; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, scratch_scope, shuffle_partitions, spread, written
from .graph import components, spanning

#: Vectors in a square's side at most, and at least where a component is dealt to several tasks.
SQUARE, LEAST_SQUARE = 2000, 128


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, k, unit): a hash of the vector and it as doubles of length one; both null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for row in batch.column(1):
                own = np.array([np.nan] if not row.is_valid else row.values.to_numpy(zero_copy_only=False), np.float64)
                size = np.sqrt(own @ own) if len(own) and np.isfinite(own).all() else 0.0
                if not np.isfinite(size):  # too large to square
                    own = own / np.abs(own).max()
                    size = np.sqrt(own @ own)
                elif not size and len(own) and np.isfinite(own).all() and own.any():  # too small to square
                    own = own / np.abs(own).max()
                    size = np.sqrt(own @ own)
                keys.append(xxhash.xxh3_64_intdigest((own + 0.0).tobytes()) - (1 << 63) if size else None)
                units.append((own / size).tobytes() if size else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(units, pa.binary())], names=["id", "k", "unit"])

    return spread(vectors.select(key, vector)).mapInArrow(run, f"id {vectors.schema[key].dataType.simpleString()}, k bigint, unit binary")


def _stacked(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, shorter ones filled up, and their lengths."""
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in units]
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), sizes.max(initial=1)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, sizes


def hashed(classes: DataFrame, passes: range, seed: int) -> DataFrame:
    """(pass, code, k, unit): each vector with its 64 sign bits in each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _stacked(batch.column(1))
            for p in passes:
                # drawn coordinate by coordinate: a vector has the same ones whatever the longest vector of its batch
                directions = np.random.default_rng([seed, p]).standard_normal((x.shape[1], 64))
                bits = np.packbits(x @ directions > 0, axis=1).reshape(-1, 8)
                code = (np.ascontiguousarray(bits).view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(code), batch.column(0), batch.column(1)], names=["pass", "code", "k", "unit"])

    return classes.select("k", "unit").mapInArrow(run, "pass int, code bigint, k bigint, unit binary")


def _near(rows: pa.RecordBatch | pa.Table, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours of these ordered rows (pass, code, k, unit), as a spanning forest."""
    units = rows.column(3)
    x, sizes = _stacked(units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units)
    which, k = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(window, len(x) - 1) + 1):
        cosine = np.einsum("ij,ij->i", x[:-step], x[step:])
        ok = (cosine >= threshold) & (which[:-step] == which[step:]) & (sizes[:-step] == sizes[step:])
        a.append(k[:-step][ok])
        b.append(k[step:][ok])
    return spanning(np.concatenate(a), np.concatenate(b))


def missed(which: np.ndarray, code: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """For each of these ordered rows the logarithm of the probability that the window doesn't show a vector at the threshold."""
    bits = np.zeros(len(code), np.int64)
    step = window + 1
    if len(code) > step:
        differ = (code[:-step] ^ code[step:]).view(np.uint64)
        high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
        shared = 64 - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
        need = np.where(which[:-step] == which[step:], shared + 1, 0)
        bits[:-step] = need
        bits[step:] = np.maximum(bits[step:], need)
    same = 1 - np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi
    with np.errstate(divide="ignore"):
        return np.where(bits > 64, 0.0, np.log1p(-(same ** bits.astype(np.float64))))


def window_links(ordered: DataFrame, window: int, threshold: float) -> DataFrame:
    """Three kinds of rows: links (a, b) between neighbours in the passes' orders, as a spanning forest of each run of
    rows; for each row (a, miss), see missed; and the rows (pass, code, a, unit) at the ends of each task."""
    names = ["a", "b", "miss", "pass", "code", "unit"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.binary()]

    def made(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in zip(names, kinds)], names=names)

    def ends(rows: pa.RecordBatch) -> pa.RecordBatch:
        return made(rows.num_rows, **{"pass": rows.column(0), "code": rows.column(1), "a": rows.column(2), "unit": rows.column(3)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        seen, own = 0, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                if seen < window:
                    yield ends(part.slice(0, window - seen))
                seen += part.num_rows
                own.append([part.column(i).to_numpy() for i in range(3)])
                rows = part if tail is None else pa.concat_batches([tail, part])
                nodes, tops = _near(rows, window, threshold)
                yield made(len(nodes), a=nodes, b=tops)
                tail = rows.slice(max(0, rows.num_rows - window))
        if tail is not None:
            if seen > window:
                yield ends(tail.slice(max(0, 2 * window - seen)))
            which, code, k = (np.concatenate(x) for x in zip(*own))
            yield made(seen, a=k, miss=missed(which, code, window, threshold))

    return ordered.mapInArrow(run, "a bigint, b bigint, miss double, pass int, code bigint, unit binary")


def links_over_cuts(found: DataFrame, window: int, threshold: float) -> DataFrame:
    """(a, b): links between the ends of tasks, `window` rows on each side of every cut, in the order of their pass."""

    def run(table: pa.Table) -> pa.Table:
        nodes, tops = _near(table.sort_by([("code", "ascending"), ("k", "ascending")]), window, threshold)
        return pa.table({"a": nodes, "b": tops})

    ends = found.where("pass is not null").select("pass", "code", F.col("a").alias("k"), "unit")
    return ends.groupBy("pass").applyInArrow(run, "a bigint, b bigint")


def linked(classes: DataFrame, threshold: float, passes: int, window: int, seed: int, miss: float) -> DataFrame:
    """(node, component) of all vectors that link with another, after as many rounds of passes as miss asks for."""
    first, parts, before = 0, None, None
    while True:
        order = hashed(classes, range(first, first + passes), seed).repartitionByRange(shuffle_partitions(classes.sparkSession), "pass", "code", "k")
        found = written(window_links(order.sortWithinPartitions("pass", "code", "k"), window, threshold))
        edges = found.where("b is not null").select("a", "b").unionByName(links_over_cuts(found, window, threshold))
        chances = found.where("miss is not null").select("a", "miss")
        if parts is not None:
            edges = edges.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
            chances = chances.unionByName(before)
        now = written(components(edges))
        after = written(chances.groupBy("a").agg(F.sum("miss").alias("miss")))
        dropped(found, *(x for x in (parts, before) if x is not None))
        parts, before, first = now, after, first + passes
        crowds = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window), "component").select(F.col("node").alias("a"))
        left = before.join(crowds, "a", "left_anti").agg(F.avg(F.exp("miss"))).first()[0]
        if left is None or left <= miss:
            return parts


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(k, links): how many other vectors of the component each class links with, copies of others included."""
    n = F.count(F.lit(1))
    sides = members.groupBy("component").agg(F.greatest(F.ceil(n / SQUARE), F.least(F.ceil(n / LEAST_SQUARE), F.lit(8))).cast("int").alias("side"))
    rows = members.join(sides, "component").withColumn("own", F.pmod(F.xxhash64("k"), F.col("side")).cast("int"))
    squares = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "k", "copies", "unit"
    )

    def square(table: pa.Table) -> pa.Table:
        same = table["i"][0].as_py() == table["j"][0].as_py()
        x, sizes = _stacked(table["unit"].combine_chunks())
        copies = table["copies"].to_numpy()
        left = table["left"].to_numpy(zero_copy_only=False)
        rows, cols = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(rows), 500):
            r = rows[lo : lo + 500]
            ok = (x[r] @ x[cols].T >= threshold) & (sizes[r][:, None] == sizes[cols][None, :])
            if same:
                ok &= r[:, None] != cols[None, :]
            else:
                out[cols] += copies[r] @ ok
            out[r] += ok @ copies[cols]
        return pa.table({"k": table["k"], "links": pa.array(out)})

    # the rows are already dealt by component, which would do for these groups too; a large component's squares are to spread
    dealt = squares.repartition("component", "i", "j")
    return dealt.groupBy("component", "i", "j").applyInArrow(square, "k bigint, links bigint").groupBy("k").agg(F.sum("links").alias("links"))


def embedding_near_dedup(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, passes: int = 8, window: int = 32, seed: int = 42, miss: float = 1e-3
) -> DataFrame:
    """key, n_links, component_id and kept of every row of vectors; passes are those of a round."""
    with scratch_scope():
        return kept(_labelled(vectors, key, vector, threshold, passes, window, seed, miss))


def _labelled(vectors: DataFrame, key: str, vector: str, threshold: float, passes: int, window: int, seed: int, miss: float) -> DataFrame:
    units = written(unit_vectors(vectors, key, vector))
    classes = written(units.where("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    parts = linked(classes, threshold, passes, window, seed, miss)
    members = classes.join(parts.select(F.col("node").alias("k"), "component"), "k")
    links = written(link_counts(members.select("k", "copies", "unit", "component"), threshold))
    named = classes.select("k", "id", "copies").join(parts.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    labels = named.join(least, "component").join(links, "k", "left").select(F.col("k").alias("ck"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    return units.select("id", "k").join(labels, F.col("k") == F.col("ck"), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "id").alias("component_id"),
        F.coalesce("least", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


#: The query as DuckDB SQL: all pairs, which the passes needn't look at.
ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, l.component_id = v.vec_id AS kept FROM v JOIN least l ON l.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
