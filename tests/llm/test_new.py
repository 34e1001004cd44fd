"""Spelling variants, the prefix trie and token files against brute force, with the cases that matter."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from corpus import SCHEMA, documents, frame

from curator.llm import prefix_trie
from curator.llm.prefix_trie import conversation_trie
from curator.llm.spelling import Acceptor, near_words, one_edit_pairs, spelling_variants, vocabulary
from curator.llm.token_files import joined_crc32, read_token_ids, token_digests, write_token_ids


# ----------------------------------------------------------------- spelling
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    rows = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = [form, n, len(near), counts[form] if form else None]
    root = lambda w: w if rows[w][0] is None else root(rows[w][0])
    return {(w, form, root(w), n, k, fn) for w, (form, n, k, fn) in rows.items()}


def some_words(seed=0, n=300):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(n)}
    words |= {"z" * 70, "z" * 71, "z" * 35 + "y" + "z" * 35, "z" * 300, "y" + "z" * 299, "x" * 500}
    return {w: rng.choice([1, 2, 5, 5, 30, 200, 1000]) for w in sorted(words)}


@pytest.mark.parametrize("most", [2000, 20, 2])
def test_variants_of_words(spark, most):
    counts = some_words()
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = spelling_variants(words, 5, most).collect()
    assert len(got) == len(counts)
    assert {tuple(r) for r in got} == plain_variants(counts)


def test_partition_of_one_place_is_not_split(spark):
    """All words agree but for one place: they can't be told apart further, whatever the limit."""
    counts = {f"abc{chr(97 + i)}def": 1 + i for i in range(26)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {r.word: r.n_near for r in near_words(words, most=3).collect()} == dict.fromkeys(counts, 25)


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abcd" for b in "xy" for c in ("", "s"))
    a = Acceptor(words)
    accepted = []
    stack = [("", a.initial)]
    while stack:
        w, s = stack.pop()
        accepted += [w] if a.final[s] else []
        stack += [(w + c, t) for c, t in a.arcs[s].items()]
    assert sorted(accepted) == words
    assert len(a.arcs) == 4  # in front, behind one letter, behind two, at the end
    short, long = ["aab", "abb", "bbb"], ["aaab", "abab", "bbbb"]
    want = {(x, y) for x in short for y in short + long if one_edit(x, y) and (len(y) > len(x) or x < y)}
    got = list(one_edit_pairs(short, long, True))
    assert {(min(p, key=lambda w: (len(w), w)), max(p, key=lambda w: (len(w), w))) for p in got} == want
    assert len(got) == len(want)


def test_vocabulary(spark):
    rows = documents()
    rows += [(None, "Straße straße STRASSE naïveté NAÏVETÉ Ünlike", "en", None, 1, "x", 1)] * 6
    rows += [(900 + i, "longword" * 3000 + f" sévère{'é' * i} colour", "en", "s", 1, "x", 1) for i in range(400)]
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = frame(spark, rows)
    got = vocabulary(docs)
    assert {r.word: r.n for r in got.collect()} == want
    assert {tuple(r) for r in spelling_variants(got).collect()} == plain_variants(want)
    other = docs.withColumnsRenamed({"doc_id": "n", "text": "word"}).withColumnRenamed("lang", "text")
    assert {r.word: r.n for r in vocabulary(other, key="n", text="word").collect()} == want


def test_no_words(spark):
    for rows in ([], [(1, None, None, None, None, None, None), (2, "a b c 123", None, None, None, None, None)]):
        assert spelling_variants(vocabulary(spark.createDataFrame(rows, SCHEMA))).collect() == []


# --------------------------------------------------------------------- trie
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, out = Counter(p[:-1] for p in members if p), []
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((len(p), min(cs), parent, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed=0, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        texts = [rng.choice(["hello", "é" * rng.randint(0, 3), None, "so"]) for _ in range(rng.randint(1, 9))]
        rows += [(c, i if rng.random() < 0.97 else None, rng.choice(["user", "bot", None]), t) for i, t in enumerate(texts)]
    rows += [(c, i, "user", f"same {i}") for c in range(1000, 1040) for i in range(3)]  # copies, and a base among them
    rows += [(c, i, "user", f"deep {i}") for c in (2000, 2001, 2002) for i in range(70 - c % 7)]  # deep ones with common beginnings
    rows += [(c, 0, "a", "b") for c in range(4101, 4110)]  # no base: some are left without turns
    rows += [(-5, 1, "x", "y"), (-5, 1, "x", "y"), (-5, 1, "x", "z"), (None, 1, "x", "y"), (5, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(block)
    random.Random(1).shuffle(rows)
    got = conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "a", "b")],
        [(7, i, "a", "b") for i in range(9)],
        [(c, 0, "a", "b") for c in (4103, 4104, 4105, 4106)],
        [(c, 0, "a", "b" * 100_000) for c in range(3)],
    ],
)
def test_small_tries(spark, rows):
    got = conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(tuple(r) for r in got) == plain_trie(rows)


def test_trie_ignores_other_columns(spark):
    rows = conversations(9, 30)
    plain = spark.createDataFrame(rows, TURNS)
    more = plain.selectExpr("*", "conv_id AS member", "text AS digest", "turn AS depth", "role AS len")
    assert sorted(conversation_trie(more).collect(), key=str) == sorted(conversation_trie(plain).collect(), key=str)


# -------------------------------------------------------------- token files
def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def written_files(docs, tmp_path, **names):
    path = f"file://{tmp_path}/files"
    write_token_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, **names)
    return path


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    rows = documents()
    docs = frame(spark, rows)
    path = written_files(docs.withColumnRenamed("doc_id", "ids").withColumnRenamed("text", "start"), tmp_path, key="ids", text="start")
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r[0], len(ids), crc(ids)) for r, ids in zip(rows, plain_ids([r[1] for r in rows])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert max(r.n_tokens for r in got) > 4096  # a document of several rows
    assert any(r.n_tokens == 1 for r in got)
    ids = read_token_ids(spark, path).collect()
    assert {(r.doc_id, r.start, crc(r.ids)) for r in ids} == {(r.doc_id, r.start, r.ids_crc32) for r in got}
    some = read_token_ids(spark, path, [7, 3])
    assert {r.doc_id for r in some.collect()} == {3, 7}
    plan = some._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id, \[(3,7|7,3)\]\)", plan)


def test_stripes_have_indexes_and_bloom_filters(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text")
    path = written_files(docs.repartition(2), tmp_path)
    files = sorted((tmp_path / "files" / "tokens").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 4000
    assert all(orc.ORCFile(f).row_index_stride == 1000 for f in files)
    shards = sorted(spark.read.orc(f"{path}/shards").collect())
    assert len(shards) == len([f for f in files if orc.ORCFile(f).nrows])
    assert all(a.last_doc < b.first_doc and a.before + a.n_tokens == b.before for a, b in zip(shards, shards[1:]))
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(files[0])), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    # the stripe's footer lists its streams; those of Bloom filters are of the document ids' column
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = [footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())]
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
    encodings = [footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())]
    assert encodings.count("DIRECT_V2") >= 7
    assert read_token_ids(spark, path, [5]).collect() == []  # between the ids that are there


def test_no_documents(spark, tmp_path):
    path = written_files(spark.createDataFrame([], SCHEMA), tmp_path)
    assert token_digests(spark, path).collect() == [] and read_token_ids(spark, path, [1]).collect() == []


def test_joined_sums():
    rng = random.Random(2)
    for n in (0, 1, 5, 4096):
        a, b = rng.randbytes(33), rng.randbytes(n)
        assert joined_crc32(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_prefix_trie"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import assert_same, connection

    from curator.llm import queries

    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connection(sf_dir))


def test_token_files_query(spark, sf_dir):
    from curator.llm.queries import op13_token_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    at, want = 0, []
    for r, ids in zip(docs, plain_ids([r.text for r in docs])):
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, op13_token_files(spark, sf_dir).collect())) == want


def test_whole_texts_are_encoded_as_the_library_does():
    import random

    import numpy as np
    from curator.llm import token_files
    from curator.llm.queries import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    own, library = token_files.text_coder(open(path).read(), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    parts = [" ", "  ", "\n", "\n\n", "the", "Fox's", "ing", "12345", "é", "😀", "<|endoftext|>", "<|end", "\t", "...", "x" * 70, "\u3000", "\x00"]
    for text in ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(300))]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
