"""Document operators against brute force on a small corpus."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus import SCHEMA, documents, frame, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curator.llm import ngram_join, substring_dedup
from curator.llm.bpe import BacktrackEncoder, decode_bpe, encode_bpe, merged_by_rank, read_ranks
from curator.llm.line_dedup import dedup_lines
from curator.llm.packing import pack, pack_histogram
from curator.llm.quality_rules import COUNTS, filter_quality, quality_rules

ROWS = documents()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------- quality rules
def base(text):
    w = words_of(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def normal(line):
    return re.sub("[\t\x0b\x0c\r]", " ", line.lower()).strip(" ")


def verdicts(rows, max_docs, min_left):
    """(key, host, text) -> (characters in frequent lines, kept, text without them), by the rule's own words."""
    holders = defaultdict(set)
    for _, t, host in rows:
        for x in (t or "").split("\n"):
            holders[host, normal(x)].add(t)
    out = {}
    for i, t, host in rows:
        own = [(x, normal(x)) for x in (t or "").split("\n")]
        hot = {y for _, y in own if y and len(holders[host, y]) > max_docs}
        total, lost = sum(len(y) for _, y in own), sum(len(y) for _, y in own if y in hot)
        n, *_, repeats = base(t)
        failed = n < 10 or 100 * repeats > 20 * n
        out[i, host, t] = lost, not failed and total - lost >= min_left * total, "\n".join(x for x, y in own if y not in hot) if hot else t
    return out


@pytest.mark.parametrize("max_docs", [2, 4])
def test_quality_rules(spark, docs, max_docs):
    limit = dict(max_docs=max_docs, min_left=0.3)
    got = sorted(quality_rules(docs, **limit).collect(), key=str)
    assert len(got) == len(ROWS)
    plain = {(r[0], base(r[1])) for r in ROWS}
    assert {(r.doc_id, tuple(r[c] for c in COUNTS)) for r in got} == plain
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    want = verdicts([(r[0], r[1], r[3]) for r in ROWS], **limit)
    assert {(r.doc_id, r.line_chars, r.kept) for r in got} == {(i, lost, kept) for (i, *_), (lost, kept, _) in want.items()}
    assert any(r.line_chars for r in got)
    kept = filter_quality(docs, **limit)
    assert kept.columns == docs.columns and {r._q_id for r in kept.collect()} <= {"x", None}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r[0], want[r[0], r[3], r[1]][2]) for r in ROWS if want[r[0], r[3], r[1]][1])
    assert quality_rules(empty(spark)).count() == 0 and filter_quality(empty(spark)).count() == 0


def test_lines_at_and_above_the_limit(spark):
    """Whatever other lines the documents hold, a line of limit + 1 different documents is above it, one of just the limit isn't; copies don't count."""
    body = lambda i: "\n".join(f"own{i} line{j} " + " ".join(f"w{i * 7 + j}x{k}" for k in range(9)) for j in range(1 + i % 6))
    rows = []
    for host in range(30):
        for i in range(21 if host % 2 else 20):
            rows.append((100 * host + i, f"{body(100 * host + i)}\nShared {host}", "en", f"h{host}", 1, None, None))
        rows += [(100 * host + 50 + i, rows[-1][1], "en", f"h{host}", 1, None, None) for i in range(20)]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert {i: r.line_chars > 0 for i, r in got.items()} == {r[0]: r[0] // 100 % 2 == 1 for r in rows}
    whole = " ".join(f"a{k}" for k in range(12))
    half = [(i, f"{whole}\n" + f"{i:04d} " * 3, "en", "h", 1, None, None) for i in range(30)]
    lost, left = len(whole), len("0000 0000 0000")
    edge = left / (lost + left)
    assert {r.kept for r in quality_rules(frame(spark, half), min_left=edge - 1e-9).collect()} == {True}
    assert {r.kept for r in quality_rules(frame(spark, half), min_left=edge + 1e-9).collect()} == {False}


def test_depleted_documents_go_and_copies_stay(spark):
    long_line = lambda x: " ".join(f"{x}{k}" for k in range(30))
    menu = "\n".join(long_line(x) for x in "abc")
    rows = [(i, menu + "".join(f"\nown{i} line{j} of{j}" for j in range(7)), "en", "h", 1, None, None) for i in range(40)]
    body = "\n".join(long_line(f"copy{x}") for x in range(8))
    rows += [(100 + i, body, "en", "h", 1, None, None) for i in range(40)]
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(40))


# ------------------------------------------------------------------ line dedup
def test_line_dedup(spark, docs):
    rows = sorted({(r[0], r[1]) for r in ROWS}, key=lambda r: (r[0] is None, r[0]))
    seen, want = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate(lines) if x.strip(" \t\r\x0b\f")]
        gone = set()
        for j in range(len(full) - 2):
            key = tuple(x for _, x in full[j : j + 3])
            if key in seen:
                gone |= set(range(full[j][0], full[j + 2][0] + 1))
            seen.add(key)
        want[i] = (len(lines) if t else 0, len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = dedup_lines(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 10
    assert dedup_lines(empty(spark)).count() == 0


# ------------------------------------------------------------------ n-gram join
def brute_jaccard(rows, n=5, t=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = words_of((text or "").translate(lower))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, docs, monkeypatch, small):
    if small:  # long columns, several squares and columns dealt to several blocks
        for name, value in (("SHORT", 2), ("SQUARE", 2), ("LEAST_SQUARE", 1), ("WIDE", 2), ("BLOCK", 50), ("BITS", 12)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = {(r[0], r[1]) for r in ROWS if r[0] is not None}
    want = brute_jaccard(rows)
    got = ngram_join.ngram_jaccard(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_ngram_join_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "SQUARE", 10)
    import random

    rng = random.Random(2)
    text = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        own = list(text)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own), "en", "h", 1, None, None))
    want = brute_jaccard({(r[0], r[1]) for r in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard(frame(spark, rows)).collect()} == want


def test_ngram_join_at_the_bound(spark):
    """Pairs on both sides of every similarity near the bound, at many sizes, a frequent passage in all of them; counting mustn't drop any."""
    import random

    rng = random.Random(17)
    rows, passage = [], " ".join(f"common{i}" for i in range(12))
    for i in range(120):
        n = rng.randint(5, 60)
        own = [f"d{i}w{j}" for j in range(n)]
        other = list(own)
        for _ in range(rng.randint(0, 2)):
            other[rng.choice([0, -1, rng.randrange(n)])] = f"d{i}x{rng.randrange(9)}"
        extra = f" {passage}" if i % 2 else ""
        rows += [(2 * i, " ".join(own) + extra, "en", "h", 1, None, None), (2 * i + 1, " ".join(other[rng.randint(0, 2) :]) + extra, "en", "h", 1, None, None)]
    want = brute_jaccard({(r[0], r[1]) for r in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard(frame(spark, rows)).collect()} == want
    assert 30 < len({c for _, c in want.values()}) < 220
    assert ngram_join.ngram_jaccard(empty(spark)).count() == 0


# ------------------------------------------------------------- substring dedup
@pytest.mark.parametrize("width, hot", [(6, None), (20, None), (6, 1), (6, 3)])
def test_substring_dedup(spark, docs, monkeypatch, width, hot):
    if hot:  # most windows are segments of their own
        monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = sorted({(r[0], r[1]) for r in ROWS}, key=lambda r: (r[0] is None, r[0]))
    seen, want = set(), {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if key in seen:
                gone |= set(range(j, j + width))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = substring_dedup.remove_repeats(docs, width=width).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_a_hot_anchor_is_split(spark, monkeypatch):
    """A phrase of five words in ever other surroundings; no shard gets more than a few of its segments."""
    import random

    monkeypatch.setattr(substring_dedup, "HOT", 50)
    rng = random.Random(13)
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(10**9)}" for _ in range(50)]
        own[20:25] = ["by", "the", "staff", "of", "here"]
        rows.append((i, " ".join(own), "en", "h", 1, None, None))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[:20]]
    docs = frame(spark, rows)
    marks = substring_dedup.repeated_anchors(docs, "text", 20, 5000)
    bits, cells, hot = marks.value
    assert len(hot) <= 1
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {r[0]: 50 * (r[0] >= 1000) for r in rows}


def test_substring_dedup_by_text_keys(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b9", text), ("b10", text), ("a", f"x {text}"), (None, text), ("b9", text)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("None", 40), ("a", 0), ("b10", 40), ("b9", 40), ("b9", 40)]


def test_suffix_automaton():
    import random

    rng = random.Random(4)
    for _ in range(60):
        automaton, texts = substring_dedup.SuffixAutomaton(), []
        for _ in range(4):
            own = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
            subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
            want = [max((k for k in range(1, e + 2) if tuple(own[e + 1 - k : e + 1]) in subs), default=0) for e in range(len(own))]
            assert automaton.statistics(own) == want
            automaton.add(own)
            texts.append(own)


# -------------------------------------------------------------------------- bpe
def test_bpe(spark, docs):
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(open(RANKS, "rb").read()), special_tokens={})
    got = decode_bpe(encode_bpe(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == coder.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert encode_bpe(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_one_very_long_piece(spark):
    """Words without any white space, of letters, digits and signs, and runs of spaces, encoded and packed."""
    texts = ["ab" * 40_000, "x" * 30_000 + " y", "漢字" * 15_000, "-=" * 20_000 + "\n" * 5_000, " " * 30_000, "a1" * 20_000]
    df = spark.createDataFrame([(i, t, "ids", 3) for i, t in enumerate(texts)] + [(0, texts[0], None, 4)], "doc_id bigint, text string, ids string, start int").repartition(2)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(open(RANKS, "rb").read()), special_tokens={})
    got = decode_bpe(encode_bpe(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(got) == 7 and all(np.frombuffer(r.ids, "<u4").tolist() == coder.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text for r in got)
    whole = Tokenizer.from_file(JSON)
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    pieces = pack(df, JSON, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == want and max(r.length for r in pieces) == 2048
    assert sum(r.length for r in pieces) == sum(want.values()) + want[0]


def test_backtracking_equals_merging():
    import random

    ranks = read_ranks(open(RANKS, "rb").read())
    encoder, rng = BacktrackEncoder(ranks), random.Random(6)
    for _ in range(3000):
        piece = "".join(rng.choice("aeinrst éßü漢0'") for _ in range(rng.randint(1, 14))).encode()
        want = [ranks[piece]] if piece in ranks else merged_by_rank(piece, ranks)
        assert encoder.encode(piece) == want
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        assert encoder.fits(a, b) == (merged_by_rank(encoder.tokens[a] + encoder.tokens[b], ranks) == [a, b])


# ---------------------------------------------------------------------- packing
def test_packing(spark, docs):
    got = pack(docs.withColumn("text", F.when(F.col("doc_id") == 3, "a <|endoftext|> b").otherwise(F.col("text"))), JSON, public_tokenizers.PATTERN, size=64).collect()
    coder = Tokenizer.from_file(JSON)
    texts = {r[0]: "a <|endoftext|> b" if r[0] == 3 else r[1] or "" for r in ROWS}
    copies = Counter(r[0] for r in ROWS)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = [*coder.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start)[:: copies[i]]:
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.length for r in got) > 0.97 * 64 * len(sequences)
    assert pack(empty(spark), JSON, public_tokenizers.PATTERN).count() == 0


def test_pack_histogram():
    import random

    rng = random.Random(7)
    for _ in range(50):
        counts = {rng.randint(1, 32): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        patterns = pack_histogram(counts, 32)
        placed = Counter()
        for pattern, packs in patterns:
            assert packs > 0 and sum(length * times for length, times in pattern) <= 32
            for length, times in pattern:
                placed[length] += times * packs
        assert placed == Counter(counts)
    assert pack_histogram({}, 32) == []


def shortest_pack_first(lengths, size):
    """One item at a time: into the pack with the most room, if it fits there."""
    packs = []
    for x in sorted(lengths, reverse=True):
        at = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
        if at is None or sum(packs[at]) + x > size:
            packs.append([x])
        else:
            packs[at].append(x)
    return packs


def test_shortest_pack_goes_first():
    import random

    assert sorted(pack_histogram({60: 1, 50: 1, 30: 1}, 100)) == [([(50, 1), (30, 1)], 1), ([(60, 1)], 1)]  # the fullest pack would be 60's
    rng = random.Random(11)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        got = [sum(x * k for x, k in pattern) for pattern, packs in pack_histogram(counts, 40) for _ in range(packs)]
        # packs of equal length are interchangeable, so their lengths tell all
        assert sorted(got) == sorted(map(sum, shortest_pack_first([x for x, k in counts.items() for _ in range(k)], 40)))


