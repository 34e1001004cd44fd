"""Toxicity: a weighted lexicon matched by Aho-Corasick, normalised by length, with exception phrases.

Texts are folded first: lower case, look-alikes of other scripts and full-width forms to Latin letters, marks dropped,
digits and signs that stand for letters inside words replaced, everything else between words one space. The lexicon
holds beginnings of words and whole words. It is learned: each entry's weight is the logarithm of how much more often
labelled toxic documents hold it than others do, entries are chosen so that few of them cover the toxic documents, and
phrases around an entry that only documents without the label use are exceptions: hits inside them don't count. The
score is a logistic function of the summed weights and of their density.

Labels are learned from at most ``sample`` labelled documents (chosen by a hash of their key); the lexicon and the
model have a bounded size. Scoring reads every whole text.

Edge cases: a null or empty text has no hits and gets the score of a text without any; rows without a label, with a
null label or null key teach nothing; several labels of one key count as their maximum; repeated texts teach once;
without any toxic example every score is that of no hits; an empty table gives an empty result; other columns are
ignored by ``score`` except those named.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, text_chunks, written

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans("авеёзіїјкмнорсԛѕтухԝьһԁɡαεηικνορτυχωѵոսցքօ", "abeeeiijkmhopcqstyxwbhdgaehiknoptuxwvnugqo")
#: Digits and signs that stand for letters inside a word.
DIGITS = str.maketrans("013456789@$!|", "oieasgtbgasil")
_MIXED = re.compile(r"\b(?=[\w@$!|]*[^\W\d_])(?=[\w@$!|]*[\d@$!|])[\w@$!|]+")
_HINT = re.compile(r"[^\W\d_][\d@$!|]|[\d@$!|][^\W\d_]")
SHORTEST, LONGEST = 4, 10


class _Fold(dict):
    """Character by character: what it is folded to; a space for what isn't a letter or digit."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        out = "".join(c.translate(LOOK_ALIKES) if c.isalnum() else "" if unicodedata.category(c) in ("Mn", "Cf") else " " for c in plain)
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The folded text between two spaces."""
    if _HINT.search(text):
        text = _MIXED.sub(lambda m: m[0].rstrip("@$!|").translate(DIGITS) + " ", unicodedata.normalize("NFKC", text))
    return f" {' '.join(text.translate(_FOLD).split())} "


def held_out(key: Column) -> Column:
    """The rows from which nothing is learned."""
    return F.crc32(key.cast("string")) % 4 == 2


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    model: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def __post_init__(self):
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def matcher(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.automaton.add_word(phrase, (len(phrase), phrase, 0.0))
            for entry, weight in self.weights.items():
                self.automaton.add_word(entry, (len(entry), entry, weight))
            self.automaton.make_automaton()
        return self.automaton

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(end, entry, weight) of matches that no exception covers; of entries that begin a word together the heaviest counts."""
        if not self.weights:
            return []
        best: dict[int, tuple[int, str, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, entry, weight) in self.matcher().iter(folded):
            begin = end - length + 1
            if not weight:
                spared.append((begin, end))
            elif begin not in best or best[begin][2] < weight:
                best[begin] = (end, entry, weight)
        if not spared:
            return list(best.values())
        spared.sort()
        left, at, reach = [], 0, -1
        for begin in sorted(best):  # covered if one of the exceptions that began by here ends no sooner
            while at < len(spared) and spared[at][0] <= begin:
                reach = max(reach, spared[at][1])
                at += 1
            if best[begin][0] > reach:
                left.append(best[begin])
        return left

    def measures(self, text: str) -> tuple[float, float]:
        """The logarithms of the summed weights and of their sum for a hundred words."""
        folded = fold(text)
        total = sum(weight for _, _, weight in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 20)) if total else 0.0

    def score(self, text: str) -> float:
        a, b = self.measures(text)
        return 1 / (1 + math.exp(-(self.model[0] + self.model[1] * a + self.model[2] * b)))


def _features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split()):
        if len(word) >= SHORTEST - 1:
            out.add(f" {word} ")
            out.update(" " + word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


def _cover(toxic: list[set[str]], weights: dict[str, float], least: int, depth: int = 8) -> list[str]:
    """Entries, each taken for the most documents that aren't covered `depth` times yet, until that is fewer than `least`."""
    where: dict[str, list[int]] = defaultdict(list)
    for i, own in enumerate(toxic):
        for x in own:
            where[x].append(i)
    need = [depth] * len(toxic)
    gain = {x: len(v) for x, v in where.items()}
    chosen: list[str] = []
    while gain:
        best = max(gain, key=lambda x: (gain[x] * (1 + 0.03 * len(x)), weights[x], x))  # longer ones say less about other words
        taken = gain.pop(best)
        if taken < least:
            if max(gain.values(), default=0) < least:
                break
            continue
        if any(best.startswith(c) and weights[c] >= weights[best] for c in chosen):
            continue  # whatever holds it holds that one, which weighs more
        chosen.append(best)
        for i in where[best]:
            need[i] -= 1
            if need[i] == 0:
                for x in toxic[i]:
                    if x in gain:
                        gain[x] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Newton's method; slopes aren't negative."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6, *[ridge * len(x)] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, purity: float = 0.5, entries: int = 20_000, exceptions: int = 5_000) -> Lexicon:
    """The lexicon from at most about `sample` labelled documents outside the held-out part.

    It is chosen from the `entries` most frequent word beginnings of which at least `purity` of the documents are
    toxic, and has the `exceptions` most frequent exception phrases at most: both bound what the driver holds.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_t_key")).agg(F.max(label).alias("_t_label"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_t_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    own = docs.select(F.col(key).alias("_t_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(chosen), F.col("_t_doc") == F.col("_t_key")).select("_t_label", "text")
    known = written(texts.groupBy(F.xxhash64("text").alias("_t_hash")).agg(F.max("_t_label").alias("y"), F.first("text").alias("text")).select("y", "text"))
    totals = {r["y"] > 0: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            bad, all_of = Counter(), Counter()
            for y, t in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                own = _features(t)
                all_of.update(own)
                if y > 0:
                    bad.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(all_of)), pa.array([bad[x] for x in all_of], pa.int64()), pa.array(list(all_of.values()), pa.int64())], names=["entry", "bad", "n"])

    counts = known.mapInArrow(count, "entry string, bad bigint, n bigint").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    least = max(3, toxic // 500)
    strong = counts.where((F.col("bad") >= least) & (F.col("bad") >= purity * F.col("n"))).orderBy(F.desc("bad"), "entry").limit(entries).collect()
    weights = {r["entry"]: math.log((r["bad"] + 0.5) / (toxic + 1)) - math.log((r["n"] - r["bad"] + 0.5) / (clean + 1)) for r in strong}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            out = [sorted(_features(t) & weights.keys()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["entries"])

    documents = [set(r["entries"]) for r in known.where("y > 0").mapInArrow(held, "entries array<string>").collect()]  # at most `sample`
    lexicon = Lexicon({x: weights[x] for x in _cover(documents, weights, least)})

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            rows = []
            for y, t in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                folded = fold(t)
                found = set()
                for end, entry, _ in lexicon.hits(folded):
                    begin, stop = end - len(entry) + 1, folded.index(" ", end)
                    before = folded.rfind(" ", 0, begin) if begin else -1
                    after = folded.find(" ", stop + 1)
                    found |= ({folded[before : stop + 1]} if before >= 0 else set()) | ({folded[begin : after + 1]} if after > 0 else set())
                rows += [(x, int(y > 0)) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([y for _, y in rows], pa.int64())], names=["phrase", "y"])

    spared = known.mapInArrow(phrases, "phrase string, y bigint").groupBy("phrase").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    lexicon.exceptions = [r["phrase"] for r in spared.where("n - bad >= 5 and bad * 20 <= n").orderBy(F.desc("n"), "phrase").limit(exceptions).collect()]
    lexicon.automaton = None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            x = np.array([lexicon.measures(t) for t in texts.to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "a", "b"])

    rows = known.mapInArrow(measure, "y int, a double, b double").toArrow()  # at most `sample`
    x = np.column_stack([rows["a"].to_numpy(), rows["b"].to_numpy()])
    lexicon.model = _logistic(x, (rows["y"].to_numpy() > 0).astype(float))
    lexicon.automaton = None
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score and predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text):
            scores = [shared.value.score(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(scores, pa.float64())], names=["_t_key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = spread(docs.select(key, text)).mapInArrow(run, f"_t_key {kind}, score double")
    return scored.select(F.col("_t_key").alias(key), F.coalesce(held_out(F.col("_t_key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
