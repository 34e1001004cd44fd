"""Packing: shortest-pack-first over the histogram of lengths.

Texts are tokenised and cut into pieces of at most ``size`` ids. The histogram of piece lengths (at most ``size``
entries, whatever the input) goes to the driver, where lengths are placed longest first: each goes into the shortest
packs, those with the most room, or opens new ones if it doesn't fit there, and only the counts of packing patterns
change. Every length then knows which
ranks of its pieces go to which pattern and slot, a table of a few entries per length. Pieces get a rank within their
length from a running number within their task plus the count in earlier tasks, so no task gathers a length.

Edge cases: a null or empty text is one piece that holds only the end id; repeated rows and null keys are packed like
any other; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordCoder, _file, _once
from .common import spread, text_chunks, written


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times), ...] with the number of packs of each; every item is placed."""
    open_packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {size: []}
    rooms: list[int] = []
    done: list[tuple[list[tuple[int, int]], int]] = []

    def put(pattern: list[tuple[int, int]], packs: int, room: int) -> None:
        if not packs:
            return
        if not room:
            done.append((pattern, packs))
            return
        if room not in open_packs:
            open_packs[room] = []
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((pattern, packs))

    def extended(pattern: list[tuple[int, int]], length: int, times: int) -> list[tuple[int, int]]:
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + times)]
        return [*pattern, (length, times)]

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, packs = open_packs[room].pop()
                if not open_packs[room]:
                    rooms.pop()
                # as often as these packs stay the shortest
                times = min(room // length, (room - rooms[-1]) // length + 1 if rooms else room)
            else:
                room, pattern, packs = size, [], -(-left // (size // length))
                times = size // length if left >= size // length else left
            if pattern and left < packs * times:  # a round less often, or only some of them once more
                times = max(1, left // packs)
            full = min(packs, left // times)
            put(extended(pattern, length, times), full, room - times * length)
            left -= full * times
            packs -= full
            if pattern:
                put(pattern, packs, room)
    return done + [x for packs in open_packs.values() for x in packs]


def placement(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length its slots: first rank, times in a pack, first sequence, offset."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, packs in patterns:
        offset = 0
        for length, times in pattern:
            slots.setdefault(length, []).append((ranks.get(length, 0), times, first, offset))
            ranks[length] = ranks.get(length, 0) + times * packs
            offset += length * times
        first += packs
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


PIECES = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "_task" else T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "_task", "_number")]
)


def _byte_of() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: visible Latin-1 characters themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_coders(definition: str, pattern: str):
    """How to encode a piece, and how to encode a whole word (None where its pieces are to be encoded one by one).

    Words that hold a special token go to ``tokenizers``. Others go through the same vocabulary as ranks, which is
    several times faster and gives the same ids, if the order of the merges is that of the ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    packed = lambda ids: np.array(ids, "<u4").tobytes()
    slow = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
    model = json.loads(definition)["model"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    made = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
    if any(x >= y for x, y in zip([255, *made], made)):
        return slow, lambda word: slow(word) if any(s in word for s in special) else None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return slow, lambda word: slow(word) if any(s in word for s in special) else packed(fast(word))


def pieces_of(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every text with their task and number among the task's pieces of that length."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(_file(spark, tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def make() -> WordCoder:
        return WordCoder(pattern, *piece_coders(raw.value.decode(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _once(("pieces", tokenizer_path, pattern), make)
        task, numbers = TaskContext.get().partitionId(), {}
        for batch, texts in text_chunks(batches, text):
            rows, at = [], []
            for i, t in enumerate(texts.to_pylist()):
                ids = memoryview(coder.ids(t) + end)
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    number = numbers[length] = numbers.get(length, -1) + 1
                    at.append(i)
                    rows.append((start, length, zlib.crc32(part), total, task, number))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(),) * 4 + (pa.int32(), pa.int64()))]
            keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, *PIECES.names])

    schema = T.StructType([docs.schema[key], *PIECES.fields])
    return spread(docs.select(key, text)).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = written(pieces_of(docs, tokenizer_path, pattern, end_id, size, key, text))
    by_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    slots = placement(pack_histogram(counts, size))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = by_task.select(F.col("length").alias("_length"), F.col("_task").alias("_by"), F.coalesce(before, F.lit(0)).alias("_earlier"))
    ranked = pieces.join(earlier, (F.col("length") == F.col("_length")) & (F.col("_task") == F.col("_by"))).select(
        key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_earlier") + F.col("_number")).alias("_rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                table = slots[int(length[own[0]])]
                slot = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                within = rank[own] - slot[:, 0]
                sequence[own] = slot[:, 2] + within // slot[:, 1]
                offset[own] = slot[:, 3] + within % slot[:, 1] * length[own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    fields = [*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields))
