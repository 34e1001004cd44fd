"""N-gram Jaccard self-join: which documents share so many word n-grams that their sets' similarity reaches a bound.

The document by n-gram incidence matrix is multiplied with its transpose in blocks of n-grams. Bounds derived from
the sets' sizes keep most of it from being formed: n-grams are ordered by rising document frequency (told from an
array of counters of fixed size over the whole corpus), and a pair that reaches similarity t
shares one of the first n - ceil(t n) + 1 n-grams of each; where the common n-gram stands tells how large the overlap
can still be.

1. One pass counts n-grams by hash bucket and writes for each document its set's size, hash and a parity sketch of
   about a bit for each n-gram. Documents of equal sets are one class from here on, so copies are never paired.
2. One pass sends each class's prefix n-grams to their blocks. A block sorts its entries by n-gram and counts, for the
   pairs of classes in each short column, how many of its columns both have. Long columns give a star around the class
   that holds the n-gram earliest, and are kept.
3. A pair's counts of all blocks are added up. What its sets can share besides is bounded by their sizes behind the
   prefixes and by the long columns they are in; pairs that can't reach t go, then those whose sketches can't. For the
   rest the overlap is counted on the whole sets; pairs that reach the bound are links; components follow.
4. Long columns that hold more than one component are multiplied in square blocks of bounded size: pairs of different
   components pass if size and sketch (whose differing bits can't outnumber differing n-grams) allow; then they are
   counted on the whole sets as in 3.

So every pair of different texts that links is found, or both ends are already in one component.

Edge cases: null, empty and blank texts have no n-grams and link with nothing; texts shorter than n words are one
n-gram; repeated rows are copies; a null key is a document of its own whose id is never a component's unless all are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mixed, ranges, scratch_scope, shuffle_partitions, spread, text_chunks, window_hashes, word_hashes, words_of, written
from .graph import components

#: Cells of the smallest sketch.
LEAST_CELLS = 512
#: Bits of the number of counters of document frequency. It doesn't grow with the corpus, nor does what is broadcast (a
#: byte of each); what an n-gram must be above to be told from the others of its counter grows with the corpus' root.
BITS = 20
#: Counters in a part of them.
CELLS = 4096
#: Columns of the product up to this many classes give all their pairs at once.
SHORT = 16
#: Rows and columns of a square block in step 4.
SQUARE = 2000
#: Classes of a side of a square at least, where a column is dealt to several tasks.
LEAST_SQUARE = 256
#: Prefix entries that a block holds about.
BLOCK = 400_000
#: Columns of about more classes than this are dealt to several blocks.
WIDE = 50_000


# ---------------------------------------------------------------------- sets
def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, ascending within a text, and where each text's begin."""
    words, offsets = words_of(pc.ascii_lower(texts))
    hashes = word_hashes(words)
    counts = np.diff(offsets)
    windows = window_hashes(hashes, n)
    short = (counts > 0) & (counts < n)
    sizes = np.where(short, 1, np.maximum(counts - n + 1, 0))
    out = np.zeros(int(sizes.sum()), np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(counts >= n)
    if len(full):
        out[ranges(starts[full], sizes[full])] = windows[ranges(offsets[full], sizes[full])]
    for i in np.flatnonzero(short):
        own = hashes[offsets[i] : offsets[i + 1]]
        out[starts[i]] = xxhash.xxh3_64_intdigest(own.tobytes())
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][sizes > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[starts]


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)))])
    return mixed((sums[starts[1:]] - sums[starts[:-1]]) ^ np.diff(starts).astype(np.uint64)).view(np.int64)


def sketches(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each set the parity of its members in each of as many cells as it has members or more (a power of two), as bytes.

    Two sketches of unlike size are compared after the larger one is folded: its halves' parities add up.
    """
    sizes = np.diff(starts)
    cells = np.maximum(LEAST_CELLS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    begin = np.cumsum(cells) - cells
    spot = np.repeat(begin, sizes) + (hashes & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
    bits = np.packbits(np.bincount(spot, minlength=int(cells.sum())).astype(np.uint8) & 1)
    return [bits[lo:hi].tobytes() for lo, hi in zip((begin // 8).tolist(), ((begin + cells) // 8).tolist())]


def _folded(mark: np.ndarray, words: int) -> np.ndarray:
    while mark.shape[-1] > words:
        half = mark.shape[-1] // 2
        mark = mark[..., :half] ^ mark[..., half:]
    return mark


def _needed(total: np.ndarray, t: int) -> np.ndarray:
    """The least overlap with which sets of this size sum reach t percent."""
    return -(-t * total // (100 + t))


# ------------------------------------------------------------- 1. statistics
def scanned(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Rows of two kinds from one pass: a document's key, set size, set key and sketch; or, with a part number, how many n-grams of a task's documents fall into each bucket of that part."""

    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "k", "mark", "part"]
        total, kind = np.zeros(1 << bits, np.int64), None
        for batch, texts in text_chunks(batches, text):
            hashes, starts = shingle_sets(texts, n)
            np.add(total, np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), out=total)
            ids = batch.column(batch.schema.get_field_index(key))
            kind, rows = ids.type, len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(starts).astype(np.int64)), pa.array(set_keys(hashes, starts)), pa.array(sketches(hashes, starts), pa.binary()), pa.nulls(rows, pa.int32())], names=names
            )
        parts = [(i, part.astype("<i4").tobytes()) for i, part in enumerate(total.reshape(-1, CELLS)) if part.any()]
        if parts:
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([p for _, p in parts], pa.binary()), pa.array([i for i, _ in parts], pa.int32())], names=names
            )

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"id {kind}, n bigint, k bigint, mark binary, part int")


def frequency_levels(partial: DataFrame) -> np.ndarray:
    """For each counter the logarithm of how far it is above what the n-grams that share it by chance make: their mean and four times its root."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    summed = partial.repartition(shuffle_partitions(partial.sparkSession), "part").mapInArrow(add, "part int, counts binary")
    counts = np.zeros(((1 << BITS) // CELLS, CELLS), np.int64)
    rows = summed.toArrow()  # 2 ** BITS counts
    for part, own in zip(rows["part"].to_pylist(), rows["counts"].to_pylist()):
        counts[part] = np.frombuffer(own, np.int64)
    usual = np.median(counts)  # a few frequent n-grams hardly move it
    above = np.maximum(counts.reshape(-1) - usual - 4 * np.sqrt(usual), 0)
    return np.ceil(np.log2(above + 1)).astype(np.uint8)


def _level(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    bits = len(levels).bit_length() - 1
    return levels[(hashes >> np.uint64(64 - bits)).astype(np.int64)]


# ------------------------------------------------------------- 2. the blocks
_ENTRY = np.dtype([("g", "<u8"), ("k", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _deals(level: np.ndarray) -> np.ndarray:
    """Into how many blocks a column of this frequency level is dealt."""
    return np.maximum(1, 2.0 ** level.astype(float) // WIDE).astype(np.uint64)


def _prefix_entries(hashes: np.ndarray, starts: np.ndarray, levels: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all sets' prefixes, each set once, and into how many blocks each one's column is dealt."""
    sizes = np.diff(starts)
    keys = set_keys(hashes, starts)
    _, first = np.unique(keys, return_index=True)
    first = first[sizes[first] > 0]
    pick = ranges(starts[:-1][first], sizes[first])
    h, n = hashes[pick], sizes[first]
    level = _level(h, levels)
    rank = (level.astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
    prefix = n + (-t * n // 100) + 1
    ends = np.cumsum(n)
    take = np.concatenate([lo + np.argsort(rank[lo:hi], kind="stable")[:p] for lo, hi, p in zip((ends - n).tolist(), ends.tolist(), prefix.tolist())] or [np.zeros(0, np.int64)])
    out = np.zeros(len(take), _ENTRY)
    out["g"], out["k"], out["n"] = h[take], np.repeat(keys[first], prefix), np.repeat(n, prefix)
    out["at"] = ranges(np.zeros(len(first), np.int64), prefix)
    wide = _deals(level[take])
    return out, wide


def block_rows(docs: DataFrame, text: str, n: int, t: int, levels, blocks: int) -> DataFrame:
    """(block, payload): a payload holds entries of one block from one run of texts, packed by field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, text):
            entries, wide = _prefix_entries(*shingle_sets(texts, n), levels.value, t)
            if not len(entries):
                continue
            salt = mixed(entries["k"].view(np.uint64)) % wide
            block = (mixed(entries["g"] + salt) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            entries, block = entries[order], block[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            payloads = [b"".join(entries[f][lo:hi].tobytes() for f in _ENTRY.names) for lo, hi in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(payloads, pa.binary())], names=["block", "payload"])

    return spread(docs.select(text)).mapInArrow(run, "block bigint, payload binary")


def _entries(payload: bytes) -> np.ndarray:
    m = len(payload) // _ENTRY.itemsize
    out, at = np.zeros(m, _ENTRY), 0
    for f in _ENTRY.names:
        out[f] = np.frombuffer(payload, _ENTRY[f], m, at)
        at += m * _ENTRY[f].itemsize
    return out


def _allowed(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether sizes and places let entries of one column reach the bound. It holds for a linking pair's first common n-gram."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    rest = np.minimum(na - a["at"], nb - b["at"])
    return rest >= _needed(na + nb, t)


def block_product(rows: DataFrame, t: int, levels) -> DataFrame:
    """(g, a, b, n): pairs a < b of like size with null g, and as n twice the number of short columns of the block that both have, plus one where a place allows a link; and the entries (g, a, null, n) of long columns."""

    def product(table: pa.Table) -> pa.Table:
        entries = np.concatenate([_entries(p) for p in table["payload"].to_pylist()])
        entries = entries[np.lexsort((entries["k"], entries["g"]))]
        new = np.ones(len(entries), bool)
        new[1:] = (entries["g"][1:] != entries["g"][:-1]) | (entries["k"][1:] != entries["k"][:-1])
        entries = entries[new]  # copies in other tasks
        edges = np.concatenate([[0], np.flatnonzero(np.diff(entries["g"])) + 1, [len(entries)]])
        size = np.diff(edges)
        wide = _deals(_level(entries["g"][edges[:-1]], levels.value)) > 1
        short = (size > 1) & (size <= SHORT) & ~wide
        long = (size > SHORT) | wide
        pairs = []
        for width in np.unique(size[short]):
            base = edges[:-1][short & (size == width)]
            i, j = np.triu_indices(width, 1)
            x, y = entries[(base[:, None] + i).ravel()], entries[(base[:, None] + j).ravel()]
            like = 100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= t * np.maximum(x["n"], y["n"]).astype(np.int64)
            x, y = x[like], y[like]
            # the places only have to allow it where the two sets' first common n-gram is, but all common ones count
            pairs.append((x["k"], y["k"], 2 + _allowed(x, y, t)))
        stay = []
        for lo, hi in zip(edges[:-1][long], edges[1:][long]):
            column = entries[lo:hi]
            stay.append(column)
            pivot = column[np.lexsort((column["k"], column["at"]))[:1]]
            ok = _allowed(np.repeat(pivot, len(column)), column, t) & (column["k"] != pivot["k"])
            x, y = np.repeat(pivot["k"], ok.sum()), column["k"][ok]
            pairs.append((np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64)))
        every = np.concatenate([np.stack(p, 1) for p in pairs]) if pairs else np.zeros((0, 3), np.int64)
        pair, which = np.unique(every[:, :2], axis=0, return_inverse=True)
        common = np.bincount(which.ravel(), every[:, 2] >> 1, minlength=len(pair)).astype(np.int64) << 1
        np.bitwise_or.at(common, which.ravel(), every[:, 2] & 1)
        column = np.concatenate(stay) if stay else np.zeros(0, _ENTRY)
        m, c = len(pair), len(column)
        return pa.table(
            {
                "g": pa.array(np.concatenate([np.zeros(m, np.int64), column["g"].view(np.int64) if c else np.zeros(0, np.int64)]), mask=np.arange(m + c) < m),
                "a": pa.array(np.concatenate([pair[:, 0], column["k"]])),
                "b": pa.array(np.concatenate([pair[:, 1], np.zeros(c, np.int64)]), mask=np.arange(m + c) >= m),
                "n": pa.array(np.concatenate([common, column["n"].astype(np.int64)])),
            }
        )

    return rows.groupBy("block").applyInArrow(product, "g bigint, a bigint, b bigint, n bigint")


# ------------------------------------------------------------ 3. verification
def _near(apart: np.ndarray, na: np.ndarray, nb: np.ndarray, t: int) -> np.ndarray:
    """Whether the bound can be reached: differing cells can't outnumber the n-grams that only one set has, nor can sizes differ much."""
    return (apart <= na + nb - 2 * _needed(na + nb, t)) & (100 * np.minimum(na, nb) >= t * np.maximum(na, nb))


def _behind(n, t: int):
    """How many n-grams a set of n has behind its prefix."""
    return F.ceil(F.lit(t) * n / 100) - 1


def open_pairs(pairs: DataFrame, classes: DataFrame, held: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b, common) that can still reach t by what is counted, by size and by sketch.

    Of two prefixes the one that ends first in the common order holds all common n-grams up to there, which are in
    common or in long columns (held: k, long); what follows is at most what that set has behind its prefix.
    """
    own = classes.join(held, "k", "left").withColumn("long", F.coalesce("long", F.lit(0)))
    side = lambda x: own.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("mark").alias(f"m{x}"), F.col("long").alias(f"l{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.col("common") + F.least("la", "lb") + F.greatest(_behind(F.col("na"), t), _behind(F.col("nb"), t))
    total = F.col("na") + F.col("nb")
    joined = joined.where(most * (100 + t) >= t * total).select("a", "b", "na", "nb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            apart = []
            for x, y in zip(batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                apart.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()))
            ok = _near(np.array(apart, np.int64), na, nb, t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _id_filter(ids: DataFrame, bits: int = 1 << 23):
    """A one-bit-per-hash filter over ids, of fixed size: it only spares work, an exact join follows."""
    spots = ids.select((F.xxhash64("id").bitwiseAND(bits - 1)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("v"))
    rows = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out)


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(k, members): the whole sets of the wanted classes, from the text of each one's first document."""
    spots = _id_filter(wanted)
    bits = len(spots.value) * 64
    marked = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(key).bitwiseAND(bits - 1).alias("spot")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spot = batch.column(2).to_numpy()
                yield batch.filter(pa.array((spots.value[spot >> 6] >> (spot & 63)) & 1 == 1))

        for batch, texts in text_chunks(some(), "text"):
            hashes, starts = shingle_sets(texts, n)
            members = [hashes[lo:hi].tobytes() for lo, hi in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(set_keys(hashes, starts)), pa.array(members, pa.binary())], names=["id", "k", "members"])

    kind = docs.schema[key].dataType.simpleString()
    found = marked.mapInArrow(run, f"id {kind}, k bigint, members binary")
    wanted = wanted.select(F.col("k").alias("wk"), F.col("id").alias("wid"))
    return found.join(wanted, (F.col("k") == F.col("wk")) & F.col("id").eqNullSafe(F.col("wid"))).select("k", "members")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, n: int, t: int) -> DataFrame:
    """The pairs whose whole sets reach t percent."""
    ends = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    wanted = written(ends.join(classes.select("k", "id"), "k").select("id", "k"))
    sets = written(_sets_of(docs, wanted, key, text, n))
    joined = pairs.join(sets.select(F.col("k").alias("b"), F.col("members").alias("mb")), "b").join(
        sets.select(F.col("k").alias("a"), F.col("members").alias("ma")), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                joint = np.concatenate([x, y])
                joint.sort(kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                ok.append(100 * common >= t * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a bigint, b bigint")


# ------------------------------------------------------------ 4. long columns
def cross_pairs(columns: DataFrame, classes: DataFrame, parts: DataFrame, t: int) -> DataFrame:
    """Pairs of different components in one long column that size and sketch allow."""
    labelled = written(columns.join(parts.select(F.col("node").alias("k"), "component"), "k", "left").select("g", "k", F.coalesce("component", "k").alias("c")))
    # a table of its own: the join is then planned with its size, and large columns can be split
    open_columns = written(
        labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
        .select("g", F.greatest(F.ceil(F.col("size") / SQUARE), F.least(F.ceil(F.col("size") / LEAST_SQUARE), F.lit(8))).cast("int").alias("side"))
    )
    rows = labelled.join(open_columns, "g").join(classes.select("k", "n", "mark"), "k")
    own = F.pmod(F.xxhash64("k"), F.col("side")).cast("int")
    squares = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    squares = squares.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "k", "c", "n", "mark")

    def square(table: pa.Table) -> pa.Table:
        same = table["i"][0].as_py() == table["j"][0].as_py()
        k, c, n = (table[x].to_numpy() for x in ("k", "c", "n"))
        left = table["left"].to_numpy(zero_copy_only=False)
        marks = [np.frombuffer(m.as_buffer(), np.uint64) for m in table["mark"].combine_chunks()]
        words = np.array([len(m) for m in marks])
        found = [np.zeros((0, 2), np.int64)]
        for size in np.unique(words):  # sets that can reach the bound have sketches of this size, or one of them of twice it
            own = np.flatnonzero((words == size) | (words == 2 * size))
            mark = np.stack([_folded(marks[i], size) for i in own])
            rows = np.arange(len(own)) if same else np.flatnonzero(left[own])
            cols = np.arange(len(own)) if same else np.flatnonzero(~left[own])
            step = max(1, 4_000_000 // max(1, len(cols) * size))
            for lo in range(0, len(rows), step):
                r = rows[lo : lo + step]
                apart = np.bitwise_count(mark[r][:, None, :] ^ mark[cols][None, :, :]).sum(axis=-1, dtype=np.int64)
                x, y = own[r], own[cols]
                ok = _near(apart, n[x][:, None], n[y][None, :], t) & (c[x][:, None] != c[y][None, :])
                ok &= (words[x][:, None] == size) | (words[y][None, :] == size)
                if same:
                    ok &= x[:, None] < y[None, :]
                i, j = np.nonzero(ok)
                found.append(np.stack([k[x[i]], k[y[j]]], 1))
        pairs = np.concatenate(found)
        return pa.table({"a": np.minimum(pairs[:, 0], pairs[:, 1]), "b": np.maximum(pairs[:, 0], pairs[:, 1])})

    return squares.groupBy("g", "i", "j").applyInArrow(square, "a bigint, b bigint")


# ---------------------------------------------------------------- the operator
def ngram_jaccard(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles and component_id (the least key that links reach) of every row of docs."""
    with scratch_scope():
        return kept(_labelled(docs, key, text, n, percent))


def _labelled(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    spark, t = docs.sparkSession, percent
    scan = written(scanned(docs, key, text, n))
    levels = spark.sparkContext.broadcast(frequency_levels(scan.where("part is not null").select("part", F.col("mark").alias("counts"))))
    table = scan.where("part is null").drop("part")
    full = table.where("n > 0")
    classes = written(full.groupBy("k").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("mark").alias("mark")))
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * t / 100) + 1)).first()[0] or 0
    blocks = max(4 * shuffle_partitions(spark), -(-entries // BLOCK))
    found = written(block_product(block_rows(docs, text, n, t, levels, blocks), t, levels))
    counted = found.where("g is null").groupBy("a", "b").agg(F.sum(F.shiftright("n", 1)).alias("common"), F.max(F.col("n").bitwiseAND(1)).alias("allowed"))
    pairs = counted.where("allowed = 1").drop("allowed")
    columns = found.where("g is not null").select("g", F.col("a").alias("k"))
    held = written(columns.groupBy("k").agg(F.count(F.lit(1)).alias("long")))
    links = written(verified(written(open_pairs(pairs, classes, held, t)), classes, docs, key, text, n, t))
    parts = written(components(links))
    more = written(cross_pairs(columns, classes, parts, t).distinct())
    if not more.isEmpty():
        links = links.unionByName(verified(more, classes, docs, key, text, n, t))
        parts = written(components(links))
    names = classes.select("k", F.col("id").alias("first")).join(parts.select(F.col("node").alias("k"), "component"), "k", "left")
    names = names.withColumn("component", F.coalesce("component", "k"))
    least = names.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = names.join(least, "component").select("k", "component_id")
    known = full.join(labels, "k").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return known.unionByName(table.where("n = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


#: The query as DuckDB SQL.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
    SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, md5(array_to_string(list_slice(words, i, i + 4), ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
        UNION ALL SELECT doc_id, md5(array_to_string(words, ' ')) FROM d WHERE len(words) BETWEEN 1 AND 4)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
