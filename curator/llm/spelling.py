"""Spelling variants: words of a corpus that one edit parts, and the usual form of each.

The vocabulary, as a minimal acyclic acceptor, is composed with a one-edit transducer and with the acceptor again; the
accepted pairs are the words that differ by one inserted, deleted or replaced code point. The composition is taken apart by
where it begins: a class holds the words of ``m`` and of ``m + 1`` code points, a window is a range of ``m``'s places,
and a partition the words of a class that agree in front of the window and behind it. What they agree on is the path
to the partition's initial state, so inside only the window is composed. The edit of a pair lies where both words first
differ, which is in one window alone: each pair is found once. Windows begin as the two halves of a word; partitions of
more than ``most`` words, or of windows above ``widest`` places, are halved again in rounds until they fit. A window of
one place ends that: the alphabet bounds its words. Pairs never leave their task: each partition gives sums and
the best partner of its words, which are then summed up by word.

Edge cases: null and empty texts hold no words; a null document id counts as an empty one; repeated rows count each;
runs of any length are whole words; of near words that are equally frequent, the smallest in code-point order is
the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch_scope, spread, text_chunks, written

#: Words that a task counts before it hands them on.
HELD = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


# --------------------------------------------------------------- vocabulary
def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, remove_every: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the runs of letters, one code point taken out of every `remove_every`-th by its crc32, that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % max(least_length, 1)).findall
        crc = zlib.crc32
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch, texts in text_chunks(batches, text):
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            for own, whole in zip(keys, texts.to_pylist()):
                begin = crc(f"{'' if own is None else own}:".encode())
                for word, times in Counter(runs(whole.translate(_LOWER))).items():
                    h = crc(word.encode(), begin)
                    if h % remove_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += times
                if len(counts) >= HELD:
                    yield out()
                    counts.clear()
        yield out()

    found = spread(docs.select(key, text)).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- automata
class Acceptor:
    """A minimal acyclic acceptor of words in ascending order; states are numbers, the initial one is the last made."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            self._close(path, last, same)
            path += [({}, False) for _ in range(len(word) - same)]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        self.initial = self._state(*path[0])

    def _close(self, path: list, word: str, keep: int) -> None:
        """States of the last word's path beyond `keep` become final ones; equal right languages become one state."""
        while len(path) > keep + 1:
            arcs, end = path.pop()
            path[-1][0][word[len(path) - 1]] = self._state(arcs, end)

    def _state(self, arcs: dict[str, int], end: bool) -> int:
        sign = (end, *arcs.items())
        state = self._known.get(sign)
        if state is None:
            state = self._known[sign] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(end)
        return state


def _intersection(a: Acceptor, b: Acceptor) -> Callable[[int, int], list[str]]:
    """What both a's and b's state accept; told once for each pair of states."""
    known: dict[tuple[int, int], list[str]] = {}

    def common(s: int, t: int) -> list[str]:
        if (found := known.get((s, t))) is None:
            found = [""] if a.final[s] and b.final[t] else []
            mine, other = a.arcs[s], b.arcs[t]
            for label in mine.keys() & other.keys():
                found += [label + x for x in common(mine[label], other[label])]
            known[s, t] = found
        return found

    return common


def one_edit_pairs(short: list[str], long: list[str], at_end: bool) -> Iterator[tuple[str, str]]:
    """Acceptor, one-edit transducer, acceptor: pairs of `short` that differ in one place, and of `short` and `long` by one more code point.

    All of `short` have one length, all of `long` one more. With at_end, a code point more may stand behind the whole short word.
    """
    a, b = Acceptor(sorted(short)), Acceptor(sorted(long))
    same, more = _intersection(a, a), _intersection(a, b)
    replaced: dict[int, list[tuple[str, str]]] = {}
    stack = [("", a.initial, b.initial if long else -1)]
    while stack:
        before, s, t = stack.pop()
        arcs = a.arcs[s]
        if s not in replaced:
            labels = sorted(arcs)
            replaced[s] = [(x + z, y + z) for i, x in enumerate(labels) for y in labels[i + 1 :] for z in same(arcs[x], arcs[y])]
        for x, y in replaced[s]:
            yield before + x, before + y
        if t >= 0:
            for label, to in b.arcs[t].items():
                for x in more(s, to):
                    if x[:1] != label and (x or at_end):  # else both agree for longer
                        yield before + x, before + label + x
        for label, to in arcs.items():
            stack.append((before + label, to, b.arcs[t].get(label, -1) if t >= 0 else -1))


class _Partition:
    """The words of one partition, as they come from a sorted task."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def near(self, m: int, lo: int, hi: int) -> Iterator[tuple[str, int, int, str]]:
        """(word, near words here, n of the most frequent of them, that word)."""
        cut = {w: w[lo : hi + len(w) - m] for w in self.words}
        some = next(iter(cut))
        front, back = some[:lo], some[hi + len(some) - m :]
        count: Counter[str] = Counter()
        best: dict[str, tuple[int, str]] = {}
        for x, y in one_edit_pairs([c for w, c in cut.items() if len(w) == m], [c for w, c in cut.items() if len(w) > m], hi == m):
            x, y = front + x + back, front + y + back
            for own, other in ((x, y), (y, x)):
                count[own] += 1
                rank = (-self.words[other], other)
                if own not in best or rank < best[own]:
                    best[own] = rank
        for word, times in count.items():
            yield word, times, -best[word][0], best[word][1]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, lo, hi, front, back, word, n) in order of partitions: each is composed when its last word has come."""
    key, part, rows = None, _Partition(), []

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        for *now, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    rows += part.near(*key[:3])
                    if len(rows) >= HELD:
                        yield out()
                        rows = []
                key, part = now, _Partition()
            part.words[word] = n
    if key is not None:
        rows += part.near(*key[:3])
    yield out()


# ------------------------------------------------------------------- pairs
PARTITION = ["m", "lo", "hi", "front", "back"]


def _keyed(windows: DataFrame) -> DataFrame:
    """What a word agrees on with its partition: what stands in front of its window and behind it."""
    tail = F.col("m") - F.col("hi")
    return windows.withColumn("front", F.expr("left(word, lo)")).withColumn("back", F.when(tail > 0, F.expr("right(word, m - hi)")).otherwise(""))


def _halved(windows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return windows.withColumn("_half", F.explode(halves)).select("word", "n", "m", "_half.lo", "_half.hi")


def near_words(words: DataFrame, most: int = 2_000, widest: int = 64) -> DataFrame:
    """For each word of (word, n) that has near ones: n_near, and best_n and best of the most frequent of them."""
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    windows = _halved(classes.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")).where("m > 1"))
    whole = classes.where("m = 1").select("word", "n", "m", F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    windows = windows.unionByName(whole)
    parts = None
    while windows is not None:
        now = written(_keyed(windows))
        sizes = written(now.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("size"), F.min(F.length("word")).alias("least")).where("size > 1 AND least = m"))
        fits = (F.col("size") <= most) & (F.col("hi") - F.col("lo") <= widest) | (F.col("hi") - F.col("lo") == 1)
        closed = written(now.join(sizes.where(fits), PARTITION, "left_semi"))
        parts = closed if parts is None else parts.unionByName(closed)
        large = sizes.where(~fits)
        windows = None if large.isEmpty() else _halved(now.join(large, PARTITION, "left_semi"))
    dealt = parts.select(*PARTITION, "word", "n").repartition(*PARTITION).sortWithinPartitions(*PARTITION)
    found = dealt.mapInArrow(_composed, "word string, n_near bigint, best_n bigint, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.order")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of (word, form), by doubling. A form is several times as frequent as its word, so chains are short and end."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        after = written(now.join(step, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now, last = after.select("word", "root"), after.where("moved").isEmpty()
        if last:
            return now


def spelling_variants(words: DataFrame, ratio: int = 5, most: int = 2_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n): its form is its most frequent near word, if that is `ratio` times as frequent."""
    with scratch_scope():
        words = written(words)
        near = written(near_words(words, most))
        usual = F.col("best_n") >= ratio * F.col("n")
        found = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")
        )
        found = written(found)
        roots = _roots(found.where("form IS NOT NULL"))
        out = kept(found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    return out


# --------------------------------------------------------------------- SQL
#: The same in SQL: crc32 by its table, byte by byte, and near words by what is left of a word without one code point.
ORACLE_SQL = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
  SELECT run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), crc(run, times, h, place, c) AS (
  SELECT run, times, h, 1, 4294967295 FROM runs
  UNION ALL
  SELECT run, times, h, place + 2, xor(c >> 8, t[(xor(c, ('0x' || substr(h, place, 2))::BIGINT) & 255) + 1]) FROM crc, steps WHERE place < length(h)
), hashed AS (
  SELECT run, times, xor(c, 4294967295) AS h FROM crc WHERE place > length(h)
), words AS (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n,
         CASE WHEN best_n >= 5 * n THEN (SELECT min(other) FROM pairs p WHERE p.word = w.word AND p.other_n = best_n) END AS form
  FROM words w LEFT JOIN near USING (word)
), chains(word, root, d) AS (
  SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, d + 1 FROM chains c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, coalesce((SELECT arg_max(root, d) FROM chains c WHERE c.word = f.word), word) AS root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms f
"""
