"""Byte-level BPE encoding and decoding.

Every piece (a match of the vocabulary's pattern) is encoded by backtracking: an Aho-Corasick automaton over the
vocabulary, with bytes mapped to Latin-1, gives the longest token at each position; a token follows another only if
the two are compatible, that is if plain merging of their joined bytes gives exactly these two (told from what stands
at the boundary while both are built, and memoised);
where no token fits, the last one is taken back and its next shorter prefix tried. Positions once left for dead are
never tried again, so the work is linear in the piece, and the result is that of merging by rank.

``encode_bpe`` adds ``ids`` (binary: little-endian unsigned 32-bit ids), ``decode_bpe`` adds ``decoded`` (binary: the
bytes). Nulls and empty texts give empty ids. Rows are independent, so repeated rows, ties and empty tables need no
care; other columns pass through, but one named like the output is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, text_chunks

#: Entries that a task's cache of encoded words holds at most; beyond, it starts anew. Words longer than the second aren't kept.
CACHE, LONGEST = 300_000, 64


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines "base64-token rank" of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merged_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging: the adjacent pair of least rank first, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that plain merging joins last to make this token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        _, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class BacktrackEncoder:
    """Encodes pieces under one vocabulary; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._own: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    def edges(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """What stands at the token's right (1) or left (0) end while merging builds it: ranks and bytes, from one byte to the token."""
        known = self._edges[side].get(token)
        if known is None:
            own = self.tokens[token]
            chain = [(token, own)]
            while len(own) > 1:
                own = last_merge(own, self.ranks)[side]
                chain.append((self.ranks[own], own))
            known = self._edges[side][token] = chain[::-1]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives [left, right]: no merge across the boundary comes before those inside."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= 2 * CACHE:
                self._fits.clear()
            known = self._fits[left, right] = self.reachable(left) and self.reachable(right) and not self._crossed(left, right)
        return known

    def _crossed(self, left: int, right: int) -> bool:
        a, b, rank = self.edges(left, 1), self.edges(right, 0), self.ranks.get
        i = j = 0
        never = 1 << 40
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else never
            next_b = b[j + 1][0] if j + 1 < len(b) else never
            across = rank(a[i][1] + b[j][1], never)
            if across < next_a and across <= next_b and across != never:  # of equal ranks the leftmost pair goes first
                return True
            if next_a == next_b == never:
                return False
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self._shorter:
            own = self.tokens[token]
            self._shorter[token] = next((self.ranks[own[:k]] for k in range(len(own) - 1, 0, -1) if own[:k] in self.ranks), None)
        return self._shorter[token]

    def reachable(self, token: int) -> bool:
        """Whether merging ever makes this token."""
        if token not in self._own:
            self._own[token] = merged_by_rank(self.tokens[token], self.ranks) == [token]
        return self._own[token]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [] if whole is None else [whole]
        greedy = [token for _, (_, token) in self.automaton.iter_long(piece.decode("latin-1"))]
        if self._holds(greedy, len(piece)):
            return greedy
        return self._backtracked(piece)

    def _holds(self, found: list[int], size: int) -> bool:
        """Whether these tokens, from longest matches alone, are the encoding: all reachable, neighbours compatible."""
        known, left, covered = self._fits, -1, 0
        for token in found:
            if not (self.reachable(token) if left < 0 else (fit if (fit := known.get((left, token))) is not None else self.fits(left, token))):
                return False
            covered += len(self.tokens[token])
            left = token
        return covered == size

    def _backtracked(self, piece: bytes) -> list[int]:
        size, tokens = len(piece), self.tokens
        longest = [0] * size
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends rise, so the last that begins here is the longest
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token is not None and (
                dead[at + len(tokens[token])] or not self.reachable(token) or (out and not self.fits(out[-1], token))
            ):
                token = self.shorter(token)
            if token is not None:
                out.append(token)
                at += len(tokens[token])
                token = longest[at] if at < size else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
        return out


#: A space between two characters that aren't white space always begins a piece: texts can be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")


class WordCoder:
    """Ids of texts as bytes; words between safe cuts, and the pieces in them, are cached."""

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], encode_odd: Callable[[str], bytes | None] = lambda word: None):
        find = regex.compile(pattern).findall

        class Cache(dict):
            def __init__(self, make):
                self.make = make

            def __missing__(self, key):
                value = self.make(key)
                if len(key) <= LONGEST:
                    if len(self) >= CACHE:
                        self.clear()
                    self[key] = value
                return value

        pieces = Cache(encode_piece)

        def word(text: str) -> bytes:
            odd = encode_odd(text)
            return b"".join(map(pieces.__getitem__, find(text))) if odd is None else odd

        self.first = word
        self.later = Cache(lambda text: word(" " + text))

    def ids(self, text: str) -> bytes:
        words = text.split(" ") if _TWO_SPACES.search(text) is None else _CUT.split(text)
        start = self.first(words[0]) if words[0] else b""
        return start + b"".join(map(self.later.__getitem__, words[1:]))


_CODERS: dict = {}


def _once(key, make):
    """One coder a worker process; workers serve many tasks."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = make()
    return _CODERS[key]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in keep), values], names=[*keep, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file (of bounded size), read by the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(_file(spark, ranks_path))

    def make() -> WordCoder:
        encoder = BacktrackEncoder(read_ranks(raw.value))
        packed = {token: token.to_bytes(4, "little") for token in encoder.tokens}
        return WordCoder(pattern, lambda piece: b"".join([packed[t] for t in encoder.encode(piece.encode())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _once(("encode", ranks_path, pattern), make)
        for batch, texts in text_chunks(batches, text):
            ids = pa.array([coder.ids(t) for t in texts.to_pylist()], pa.binary())
            yield with_column(batch, out, ids)

    return spread(docs).mapInArrow(run, _schema(docs, out, T.BinaryType()))


def decode_bpe(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Unknown ids are errors; null ids decode to null."""
    spark = encoded.sparkSession
    raw = spark.sparkContext.broadcast(_file(spark, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _once(("decode", ranks_path), lambda: {i: t for t, i in read_ranks(raw.value).items()})
        get = tokens.__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = part.column(part.schema.get_field_index(ids)).to_pylist()
                decoded = [None if r is None else b"".join(map(get, np.frombuffer(r, "<u4").tolist())) for r in rows]
                yield with_column(part, out, pa.array(decoded, pa.binary()))

    return encoded.mapInArrow(run, _schema(encoded, out, T.BinaryType()))


def id_count(ids):
    return (F.length(ids) / 4).cast("bigint")
