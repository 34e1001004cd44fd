"""Substring dedup: removes every word covered by a run of ``width`` words that also starts earlier in the corpus.

Reference shards hold a suffix automaton each; documents stream through it for matching statistics, and where the
longest match that ends at a word reaches ``width``, the span is repeated. A document can't be streamed against every
shard of a corpus that is its own reference, so shards are cut by content instead of broadcast: each window of
``width`` words belongs to the shard of its anchor, the least hash among its five-word grams (the leftmost of equals).
Equal windows have equal anchors, so a shard sees every copy of its windows. Windows next to each other mostly share
an anchor: such a run is shipped once, as a segment of at most 2 * width - 5 words.

1. One pass counts anchors; a bit array of bounded size marks those that occur twice or more. It only spares work.
   Anchors with more than ``HOT`` different segments, such as a short frequent phrase in ever other surroundings, are
   hot: their windows are segments of their own, whose anchor is their own hash, so no shard gathers them.
2. One pass cuts texts into segments whose anchor is marked, and writes where each occurs. Distinct segments go to
   their shard with their first place.
3. A shard takes its distinct segments in the order of their first places: each streams through the automaton of those
   before it, windows that match are repeated there too, and is then added. All other places of a segment repeat it.
4. Repeated places go back to their documents, whose covered words are dropped.

Edge cases: a null or empty text has no words and gives an empty one; order is by key (of any type that can be sorted), then place; a null key comes
after all others; rows that share a key are one document's copies, neither of which is earlier than the other at equal
places; an empty table gives an empty result; other columns pass through, whatever their names, but ``n_words``,
``n_removed`` and ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, mixed, ranges, scratch_scope, shuffle_partitions, spread, text_chunks, unused, window_hashes, word_hashes, words_of, written

GRAM = 5
#: Anchors, or segments, that a block holds about.
BLOCK = 300_000
#: Different segments (in the texts of a task's turn; summed) beyond which an anchor is hot.
HOT = 20_000
#: Hot anchors that are told apart at most (32 MB); beyond, HOT is raised.
MOST_HOT = 1 << 22
#: The bit array has 16 bits for each anchor, but at most this many (128 MB).
MOST_BITS = 1 << 30
LAST = np.iinfo(np.int64).max


# ------------------------------------------------------------------ automaton
class SuffixAutomaton:
    """Of several word sequences, each added after the others."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """A copy of state old for the shorter words that end there, reached from at."""
        copy = self._state(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            found = self.next[last].get(word)
            if found is not None:
                last = found if self.length[found] == self.length[last] + 1 else self._split(last, word, found)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                found = self.next[at][word]
                self.link[new] = found if self.length[found] == self.length[at] + 1 else self._split(at, word, found)
            last = new

    def statistics(self, words: list[int]) -> list[int]:
        """For each word, how long a run that ends there is in the automaton."""
        at = run = 0
        out = []
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                run = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                run += 1
            else:
                run = 0
            out.append(run)
        return out


# ------------------------------------------------------------------- segments
def segments_of(hashes: np.ndarray, offsets: np.ndarray, width: int, hot: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, start (in the flat words), windows, anchor, and a hash of the words. Windows with an anchor in hot (sorted) are runs of their own."""
    grams = window_hashes(hashes, GRAM)
    whole = window_hashes(hashes, width)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    if not counts.sum():
        return {x: np.zeros(0, np.int64) for x in ("text", "start", "windows")} | {x: np.zeros(0, np.uint64) for x in ("anchor", "hash")} | {"alone": np.zeros(0, bool)}
    starts = ranges(offsets[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    view = np.lib.stride_tricks.sliding_window_view(grams, width - GRAM + 1)
    at = np.concatenate([view[lo : lo + 200_000].argmin(axis=1) for lo in range(0, len(view), 200_000)])[starts] + starts
    anchor = grams[at]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    alone = np.zeros(len(starts), bool)
    if hot is not None and len(hot):
        alone = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        anchor = np.where(alone, mixed(whole[starts] ^ np.uint64(0x6A09E667F3BCC908)), anchor)
        new |= alone
    first = np.flatnonzero(new)
    windows = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    own = mixed(whole[begin] * np.uint64(0x9E3779B97F4A7C15) + whole[begin + windows - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + windows.astype(np.uint64))
    return {"text": text[first], "start": begin, "windows": windows, "anchor": anchor[first], "hash": own, "alone": alone[first]}


def _payloads(block: np.ndarray, order: np.ndarray, pack) -> pa.RecordBatch:
    """Rows (block, payload) of what pack gives for each block's indexes."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
    parts = [order[lo:hi] for lo, hi in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array([int(block[p[0]]) for p in parts], pa.int64()), pa.array([pack(p) for p in parts], pa.binary())], names=["block", "payload"])


def repeated_anchors(docs: DataFrame, text: str, width: int, anchors: int):
    """A bit array, by an anchor's leading bits, of those that occur twice or more, and the sorted hot anchors; both are bounded."""
    spark = docs.sparkSession
    bits = min(max(20, int(16 * anchors).bit_length()), MOST_BITS.bit_length() - 1)
    power = min(max(int(anchors // BLOCK).bit_length(), (4 * shuffle_partitions(spark)).bit_length()), bits - 6)
    least = max(1, HOT)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, text):
            words, offsets = words_of(texts)
            found = segments_of(word_hashes(words), offsets, width)
            anchor, times = np.unique(found["anchor"], return_counts=True)
            if not len(anchor):
                continue
            pairs = np.unique(np.stack([found["anchor"], found["hash"]], 1), axis=0)[:, 0]
            kinds = np.searchsorted(pairs, anchor, side="right") - np.searchsorted(pairs, anchor)
            # how many different segments, and in the lowest bit whether the anchor occurs twice
            count = (kinds.astype(np.uint32) << np.uint32(1)) | (times > 1).astype(np.uint32)
            block = (anchor >> np.uint64(64 - power)).astype(np.int64)
            yield _payloads(block, np.arange(len(anchor)), lambda p: anchor[p].tobytes() + count[p].tobytes())

    def mark(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(p, "<u8", len(p) // 12), np.frombuffer(p, "<u4", -1, len(p) // 12 * 8)) for p in table["payload"].to_pylist()]
        anchor, count = np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(anchor, kind="stable")
        anchor, count = anchor[order], count[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        repeated = (np.add.reduceat((count & 1).astype(np.int64), first) > 0) | (np.diff(np.concatenate([first, [len(anchor)]])) > 1)
        kinds = np.add.reduceat((count >> 1).astype(np.int64), first)
        anchor = anchor[first]
        cells = np.zeros(1 << (bits - power), np.uint8)
        cells[((anchor[repeated] >> np.uint64(64 - bits)) & np.uint64(len(cells) - 1)).astype(np.int64)] = 1
        hot = kinds > least
        return pa.table(
            {
                "block": table["block"][:1], "marks": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary()),
                "hot": pa.array([anchor[hot].tobytes()], pa.binary()), "kinds": pa.array([kinds[hot].tobytes()], pa.binary()),
            }
        )

    rows = spread(docs.select(text)).mapInArrow(emit, "block bigint, payload binary").groupBy("block").applyInArrow(mark, "block bigint, marks binary, hot binary, kinds binary").toArrow()
    out = np.zeros((1 << power, 1 << (bits - power - 3)), np.uint8)
    for block, marks in zip(rows["block"].to_pylist(), rows["marks"].to_pylist()):
        out[block] = np.frombuffer(marks, np.uint8)
    hot, kinds = (np.frombuffer(b"".join(rows[x].to_pylist()), kind) for x, kind in (("hot", "<u8"), ("kinds", "<i8")))
    while len(hot) > MOST_HOT:
        least *= 2
        hot, kinds = hot[kinds > least], kinds[kinds > least]
    return spark.sparkContext.broadcast((bits, out.reshape(-1), np.sort(hot)))


def _marked(found: dict[str, np.ndarray], marks) -> np.ndarray:
    """Segments whose anchor is marked; those of hot anchors, which have another one by then, always are."""
    bits, cells, _ = marks.value
    spot = (found["anchor"] >> np.uint64(64 - bits)).astype(np.int64)
    return ((cells[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1) | found["alone"]


def _found(batches: Iterator[pa.RecordBatch], width: int, marks) -> Iterator[tuple]:
    """From rows (id, order, text): batch, word hashes and segments with a marked anchor."""
    for batch, texts in text_chunks(batches, "_s_text"):
        words, offsets = words_of(texts)
        hashes = word_hashes(words)
        found = segments_of(hashes, offsets, width, marks.value[2])
        keep = _marked(found, marks)
        found = {x: v[keep] for x, v in found.items()}
        if len(found["text"]):
            order = batch.column(1).to_numpy()[found["text"]]
            yield batch, hashes, found | {"order": order, "place": found["start"] - offsets[found["text"]]}


def places(rows: DataFrame, width: int, marks) -> DataFrame:
    """(id, order, place, windows, hash) of every segment with a marked anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _found(batches, width, marks):
            ident = batch.column(0).to_numpy()[found["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ident, found["order"], found["place"].astype(np.int32), found["windows"].astype(np.int32), found["hash"].view(np.int64))],
                names=["id", "ord", "place", "windows", "hash"],
            )

    return rows.mapInArrow(run, "id bigint, ord bigint, place int, windows int, hash bigint")


_HEAD = (("anchor", "<u8"), ("hash", "<u8"), ("order", "<i8"), ("place", "<i4"), ("windows", "<i4"))


def shard_rows(rows: DataFrame, width: int, marks, blocks: int) -> DataFrame:
    """(block, payload): distinct segments of a run of texts, each with its first place there and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, found in _found(batches, width, marks):
            first = np.lexsort((found["place"], found["order"], found["hash"]))
            first = first[np.concatenate([[True], np.diff(found["hash"][first]) != 0])]
            block = (mixed(found["anchor"]) % np.uint64(blocks)).astype(np.int64)
            order = first[np.argsort(block[first], kind="stable")]
            low, high = hashes.astype("<u4"), (hashes >> np.uint64(32)).astype("<u2")  # 48 bits of each word

            def pack(p: np.ndarray) -> bytes:
                head = b"".join(found[x][p].astype(kind).tobytes() for x, kind in _HEAD)
                words = ranges(found["start"][p], found["windows"][p] + width - 1)
                return len(p).to_bytes(4, "little") + head + low[words].tobytes() + high[words].tobytes()

            yield _payloads(block, order, pack)

    return rows.mapInArrow(run, "block bigint, payload binary")


def _unpacked(payload: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    m, at, out = int.from_bytes(payload[:4], "little"), 4, {}
    for x, kind in _HEAD:
        out[x] = np.frombuffer(payload, kind, m, at)
        at += out[x].nbytes
    n = (len(payload) - at) // 6
    return out, np.frombuffer(payload, "<u4", n, at) | (np.frombuffer(payload, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32))


def shard_results(shards: DataFrame, width: int) -> DataFrame:
    """(hash, ord, place, repeated): a segment's first place and which of its windows also start earlier than that, as bytes."""

    def run(table: pa.Table) -> pa.Table:
        heads, words = zip(*map(_unpacked, table["payload"].to_pylist()))
        head = {x: np.concatenate([h[x] for h in heads]) for x, _ in _HEAD}
        flat = np.concatenate(words)
        length = head["windows"].astype(np.int64) + width - 1
        begin = np.cumsum(length) - length
        order = np.lexsort((head["place"], head["order"], head["hash"]))
        first = order[np.concatenate([[True], np.diff(head["hash"][order]) != 0])]
        first = first[np.lexsort((head["place"][first], head["order"][first], head["anchor"][first]))]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(head["anchor"][first])) + 1, [len(first)]])
        masks = [b""] * len(first)
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo < 2:
                continue
            automaton = SuffixAutomaton()
            for i in range(lo, hi):
                s = first[i]
                own = flat[begin[s] : begin[s] + length[s]].tolist()
                if i > lo:
                    hit = bytes(run >= width for run in automaton.statistics(own)[width - 1 :])
                    masks[i] = hit if any(hit) else b""
                if i < hi - 1:
                    automaton.add(own)
        return pa.table(
            {"hash": head["hash"][first].view(np.int64), "ord": head["order"][first], "place": head["place"][first].astype(np.int32), "repeated": pa.array(masks, pa.binary())}
        )

    return shards.groupBy("block").applyInArrow(run, "hash bigint, ord bigint, place int, repeated binary")


# ---------------------------------------------------------------- the operator
def _identity(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def ordered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a bigint in the order of their keys, null for a null one: an integer key itself, of others the rank, counted by ranges of keys."""
    if isinstance(rows.schema[key].dataType, T.IntegralType):
        return rows.withColumn(name, F.col(key).cast("bigint"))
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(shuffle_partitions(rows.sparkSession), key).sortWithinPartitions(key)
    placed = written(keys.select(F.col(key).alias("_o_key"), F.spark_partition_id().alias("_o_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_o_at")))
    sizes = placed.groupBy("_o_part").agg(F.count(F.lit(1)).alias("_o_n"))  # a row for each range
    before = F.coalesce(F.sum("_o_n").over(Window.orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(sizes.select("_o_part", before.alias("_o_before")), "_o_part").select("_o_key", (F.col("_o_before") + F.col("_o_at")).alias(name))
    return rows.join(ranked, F.col(key) == F.col("_o_key"), "left").drop("_o_key")


def repeated_spans(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(_s_id, _s_spans), a table: for every document with repeated windows, their first words and how many follow each other."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    anchors = max(1, chars // 6 * 2 // (width - GRAM + 2))
    marks = repeated_anchors(docs, text, width, anchors)
    rows = ordered(spread(docs.select(F.col(key).alias("_s_key"), F.col(text).alias("_s_text"))), "_s_key", "_s_order")
    rows = rows.select(_identity("_s_key", "_s_text").alias("_s_id"), F.coalesce("_s_order", F.lit(int(LAST))).alias("_s_order"), "_s_text")
    where = written(places(rows, width, marks))
    blocks = max(4 * shuffle_partitions(spark), anchors // 4 // BLOCK)
    first = shard_results(shard_rows(rows, width, marks, blocks), width)
    first = written(first.select("hash", F.col("ord").alias("ford"), F.col("place").alias("fplace"), "repeated"))
    both = where.join(first, "hash").where((F.length("repeated") > 0) | (F.col("ord") != F.col("ford")) | (F.col("place") != F.col("fplace")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, place, windows, at_first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = []
            for i, p, n, own, mask in zip(ident.tolist(), place.tolist(), windows.tolist(), at_first.tolist(), batch.column(4).to_pylist()):
                if not own:
                    out.append((i, p, n))
                    continue
                hit = np.flatnonzero(np.diff(np.frombuffer(b"\0" + mask + b"\0", np.uint8).astype(np.int8)))
                out += [(i, p + int(lo), int(hi - lo)) for lo, hi in zip(hit[::2], hit[1::2])]
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], names=["_s_id", "first", "count"])

    own = (F.col("ord") == F.col("ford")) & (F.col("place") == F.col("fplace"))
    spans = both.select("id", "place", "windows", own.alias("own"), "repeated").mapInArrow(run, "_s_id bigint, first int, count int")
    return kept(spans.groupBy("_s_id").agg(F.collect_list(F.struct("first", "count")).alias("_s_spans")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 20) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space)."""
    ident, spans = unused("_s_id", docs), unused("_s_spans", docs)
    with scratch_scope():
        found = repeated_spans(docs, key, text, width).toDF(ident, spans)
    joined = docs.withColumn(ident, _identity(key, text)).join(found, ident, "left").drop(ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            words, offsets = words_of(texts)
            cover = np.zeros(len(words) + 1, np.int64)
            lists = batch.column(batch.schema.get_field_index(spans))
            doc = pc.list_parent_indices(lists).to_numpy()
            flat = lists.flatten()
            begin = offsets[doc] + flat.field(0).to_numpy(zero_copy_only=False)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + flat.field(1).to_numpy(zero_copy_only=False) + width - 1, -1)
            stay = np.cumsum(cover)[:-1] == 0
            kept_before = np.concatenate([[0], np.cumsum(stay)])
            n = np.diff(offsets)
            new = kept_before[offsets]
            left = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(new), words.filter(pa.array(stay))), pa.scalar(" ", words.type))
            names = [x for x in batch.schema.names if x not in (spans, "n_words", "n_removed", "kept")]
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(n - np.diff(new)), left.cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    fields = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept")]
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(run, T.StructType([*fields, *extra]))


#: The digest query as DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 19), ' ')) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, i + j AS i FROM later, range(0, 20) r(j)
), words AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
), counts AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
