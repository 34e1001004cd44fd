"""Operators against plain scans and on edge rows."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from curator.functions import lexicon as K
from curator.functions import text as X
from curator.operators import dedup as D
from curator.operators import rewrite as R
from curator.operators import safety as Y
from curator.operators import state as S
from curator.operators import vectors as V
from curator.operators.select import balanced, select_balanced
from curator.sources import pages as P

CORE = ["ALPHA"]


def _similar(a, b):
    both = a & b
    if not a or not b:
        return 0.0
    strong = sum(w in CORE or len(w) >= 3 for w in both)
    return min(1.0, len(both) / len(a | b) * (1.5 if strong >= 2 else 1.2 if strong == 1 else 1.0))


def test_greedy_equals_a_scan(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["ALPHA", "beta", "gamma"]
    rows = [(i, sorted(set(rng.choices(words, k=rng.randint(0, 5))))) for i in range(120)]
    kept = []
    for i, own in rows:
        if all(_similar(set(own), set(rows[j][1])) < D.SIMILARITY for j in kept):
            kept.append(i)
    items = spark.createDataFrame(rows, "id bigint, keywords array<string>")
    assert sorted(r.id for r in D.greedy_kept(items, CORE).collect()) == kept


def test_greedy_chain_and_empty(spark):
    chain = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, ["bb", "cc", "dd", "ee"]), (3, ["dd", "ee", "ff"])], "id bigint, keywords array<string>")
    assert sorted(r.id for r in D.greedy_kept(chain, [], least=0.39).collect()) == [1, 3]
    assert D.greedy_kept(chain.limit(0), []).count() == 0


def test_title_keywords(spark):
    row = spark.createDataFrame([("GDP up 5% the 中国经济 a1",), (None,)], "t string").select(D.title_keywords(F.col("t"), ["中国"], ["THE"]).alias("k")).collect()
    assert set(row[0].k) == {"GDP", "UP", "5%", "中国", "国经", "经济"} and row[1].k == []


def test_selection_quotas_and_prefiltering(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice("abc"), f"s{rng.randint(0, 4)}", rng.random() < 0.2, rng.random() < 0.3, rng.randint(0, 9), rng.randint(0, 50) / 10, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), 1)
        for i in range(200)
    ]
    names = ["id", "category", "source", "is_local", "is_central", "scope_score", "priority_score", "published_at", "day"]
    want = balanced(pd.DataFrame(rows, columns=names), ["a", "b", "c"], 10, 1, {"s1": 1})
    got = select_balanced(spark.createDataFrame(pd.DataFrame(rows, columns=names)), ["day"], ["a", "b", "c"], 10, 1, {"s1": 1}).orderBy("rank").collect()
    assert [r.id for r in got] == want["id"].tolist()
    used = want["source"].value_counts()
    assert used.max() <= 3 and used.get("s1", 0) <= 1 and want["is_local"].sum() <= 1


def test_edition_bounds(spark):
    times = ["00:00:00", "06:59:59", "06:59:59.5", "07:00:00", "13:59:59", "14:00:00", "21:59:59", "22:00:00"]
    rows = spark.createDataFrame([(f"2024-01-01 {t}",) for t in times], "t string").select(X.edition(F.col("t").cast("timestamp_ntz")).alias("e")).collect()
    assert [r.e for r in rows] == ["morning"] * 3 + ["afternoon"] * 2 + ["evening"] * 2 + ["none"]


def test_blank_is_not_newline(spark):
    row = spark.createDataFrame([("\n \n",)], "t string").select(X.has_more_than_spaces(F.col("t")).alias("a"), X.has_text(F.col("t")).alias("b")).first()
    assert row.a and not row.b


def test_amount_steps_and_boost_cap(spark):
    texts = ["none", "1 yi", "10 yi", "100 yi", "1000 yi"]
    money = K.Amounts(("wanyi", 1e12), ("qianyi", 1e11), ("yi", 1e8))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(K.economic_scale(F.col("t"), money, []).alias("s")).collect()] == [20, 40, 60, 80, 100]
    cases = {"0.00001 wanyi, 5000 yi": 5e11, "0.001 wanyi, 5000 yi": 1e9, "2wanyi qianyi": 2e12, "qianyi, 9000 yi": 1e11, "0 wanyi qianyi": 1e11, "3\n yi 2 yi": 3e8, "wanyi yi": 0.0, "": 0.0}
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", K.amount_of(F.col("t"), money)).collect())
    boost = K.boosters(F.lit("xyz"), [("a", 1.5, ["x"]), ("b", 1.3, ["y"])], [("c", 1.2, F.lit(True))])
    row = spark.range(1).select(K.boosted(F.lit(50.0), boost).alias("s"), K.explained_boosters(K.explanation({"p": F.lit(3)}, boost, F.lit(65.0))).alias("e")).first()
    assert row.s == 65.0 and [x.name for x in row.e] == ["a", "b", "c"]


def test_category_of_equals_is_the_first(spark):
    assert spark.range(1).select(K.category(F.lit("zzz"), {"one": ["a"], "two": ["b"]}).alias("c")).first().c == "one"


def test_hash_slot_identity(spark):
    want = {"ab": (288, -1), "中国": (287, -1), "zz9": (199, -1), "hello": (274, -1)}
    got = spark.createDataFrame([(k,) for k in want], "g string").select("g", V.hash_slot(F.col("g")).alias("s")).collect()
    assert {r.g: (r.s.idx, r.s.sign) for r in got} == want


def test_state(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "y"), (3, "e", "z")], "k int, v string, w string")
    assert sorted(r.k for r in S.insert_or_ignore(old, new, "k", [F.col("v")]).collect()) == [3]
    assert {r.k: r.v for r in S.upsert(old, new, "k", [F.desc("v")]).collect()} == {1: "a", 2: "c", 3: "e"}
    assert {r.k: r.w for r in S.patched(old, new.where("k = 2"), "k", ["v", "w"]).collect()} == {1: None, 2: "x"}
    numbered = S.numbered_after(old, new.select("v"), "k", [F.col("v")]).orderBy("k").collect()
    assert [(r.k, r.v) for r in numbered] == [(3, "c"), (4, "d"), (5, "e")]


def test_rewrite_and_safety(spark):
    row = spark.range(1).select(
        R.with_dictionary(F.lit("abc ab"), {"ab": "x", "abc": "y"}).alias("d"), R.headline(F.lit("News: a headline that is too long"), ["News: "], []).alias("h"),
        R.section(F.lit("# t\n\n## A\n<!-- c -->\none\ntwo\n\n## B\nthree\n---\n"), "A").alias("m"),
    ).first()
    assert (row.d, row.h, row.m) == ("y x", "a headline that i…", "one\ntwo")
    rules = [Y.Rule("r", "critical", "bad", "good"), Y.Rule("q", "low", "odd")]
    row = spark.range(1).select(Y.findings(F.lit("Bad and bad, odd"), rules).alias("f"), Y.fixed(F.lit("a BAD thing"), Y.findings(F.lit("a BAD thing"), rules), rules).alias("t")).first()
    assert [(x.rule, x.hits) for x in row.f] == [("r", 2), ("q", 1)] and row.t == "a good thing"


def test_contexts_of_every_hit(spark):
    import re

    rng = random.Random(4)
    rules = [Y.Rule("a", "high", "bad|worse", "good"), Y.Rule("b", "low", r"x\d+")]
    texts = ["".join(rng.choice(["bad", "Worse", "x12", " ", "\n", "word", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", "t", Y.findings(F.col("t"), rules, 5).alias("f"))
    for r in df.withColumn("fixed", Y.fixed(F.col("t"), F.col("f"), rules)).collect():
        want, text = [], r.t
        for rule in rules:
            ends = [(m.start(), m.end()) for m in re.finditer(f"(?i){rule.pattern}", r.t or "")]
            if not ends:
                continue
            edges = [0, *(x for e in ends for x in e), len(r.t)]  # contexts end where the next hit begins
            contexts = [r.t[max(edges[2 * i], a - 5) : a] + r.t[a:b] + r.t[b : min(edges[2 * i + 3], b + 5)] for i, (a, b) in enumerate(ends)]
            want.append((rule.name, len(ends), [r.t[a:b] for a, b in ends], contexts))
            if rule.fix:
                for a, b in ends:
                    text = text.replace(r.t[a:b], rule.fix)
        assert [(x.rule, x.hits, x.found, x.contexts) for x in r.f or []] == want and r.fixed == text


def test_bad_json_and_dates(spark):
    row = spark.range(1).select(
        F.from_json(X.fenced_json(F.lit('{"k":')), "k int").alias("j"), X.date_in_url(F.lit("http://a/2024-13/01/x/2024/02/03/")).alias("d"), X.date_in_url(F.lit("http://a/x")).alias("n"),
    ).first()
    assert row.j is None and row.d == datetime.date(2024, 2, 3) and row.n is None


def test_links(spark):
    html = '<a href="/x">A long title</a><a href="//b.example/y"><b>Another</b> one</a><a href="/x">A long title</a><a href="">none</a>'
    got = P.links(spark.createDataFrame([(1, "http://a.example/p", html)], "page_id int, url string, html string"), 3, "example").orderBy("rank").collect()
    assert [(r.link, r.title) for r in got] == [("http://a.example/x", "A long title"), ("http://b.example/y", "Another one")]


def test_review_files(spark, tmp_path):
    day = tmp_path / "2024-01-02"
    day.mkdir()
    (day / "news_7.md").write_text("# t\n\n## Comment\nfine\n")
    row = P.read_reviews(spark, str(tmp_path)).first()
    assert (row.day, row.news_id) == (datetime.date(2024, 1, 2), 7)


def test_top_k_by_blocks_and_chunks(spark, monkeypatch):
    import numpy as np

    from curator.operators import vectors

    monkeypatch.setattr(vectors, "CHUNK", 15)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(50)] + [(50, None), (51, [1.0, None] * 3), (52, [1.0, 2.0]), (53, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["query"], r["rank"], r["item"], round(r["cosine"], 9)) for r in vectors.cosine_top_k(df, df, 3, most=8).collect())
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v}
    want = []
    for i, x in unit.items():
        best = sorted((-float(x @ y), j) for j, y in unit.items() if j != i and len(x) == len(y))[:3]
        want += [(i, n + 1, j, round(-c, 9)) for n, (c, j) in enumerate(best)]
    assert got == sorted(want)


def test_rewriting_logs_each_rule_that_changed_something(spark):
    from curator.operators import rewrite as R

    rules = R.rewriting_rules(["[x] ", "y: "], {"a": "b", "bb": "a", "same": "same"}, [("c+", "c")], [("c b", "z")])
    texts = ["[x] y: bb acc b  !", "same", None, "", "y: [x] q"]
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.rewritten(F.col("t"), rules).alias("r")).collect()]
    assert [r and r.title for r in got] == ["b bz!", "sbme", None, "", "[x] q"]
    assert [(x.kind, x.old, x.title) for x in got[0].log] == [
        ("prefix", "[x] ", "y: bb acc b  !"), ("prefix", "y: ", "bb acc b  !"), ("term", "bb", "a acc b  !"), ("term", "a", "b bcc b  !"), ("correction", "c+", "b bc b  !"), ("pattern", "c b", "b bz  !"),
    ]
    assert [x.old for x in got[1].log] == ["a"] and got[3].log == []
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(R.postprocessed(F.col("t"), ["[x] ", "y: "], {"a": "b", "bb": "a", "same": "same"}, [("c+", "c")], [("c b", "z")]).alias("p")).collect()
    assert [r.p.title for r in plain] == [r and r.title for r in got]


def test_hits_have_their_places(spark):
    import re

    from curator.operators.hits import hits
    from curator.operators.safety import Rule

    rules = [Rule("word", "critical", r"bad\w*", "x"), Rule("mark", "low", "!!")]
    texts = {1: "é bad!! BADLY !!!!", 2: None, 3: "", 4: "fine", 5: "bad " * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc int, t string").withColumn("id", F.lit("clash"))
    got = hits(df, rules, 2, key="doc", text="t").collect()
    want = [(i, r.name, m.start(), m[0], t[max(0, m.start() - 2) : m.end() + 2]) for i, t in texts.items() if t for r in rules for m in re.finditer(r.pattern, t, re.I)]
    assert sorted((r.id, r.rule, r.offset, r.found, r.context) for r in got) == sorted(want)
    assert all(texts[r.id][r.offset : r.offset + r.length] == r.found for r in got)


def test_hashed_ngrams_of_repeated_keys_and_odd_texts_shuffle_texts_once(spark):
    import math

    from curator.operators import vectors

    rows = [(1, "Abab\t"), (2, None), (3, ""), (1, " xé😀"), (4, "q"), (None, "zz"), (None, "zzz")] + [(i, "text %d " % i * 200) for i in range(10, 20)]
    made = vectors.hashed_ngrams(spark.createDataFrame(rows, "k bigint, t string").repartition(3), "k", F.col("t"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    want = {}
    for key, text in rows:
        seen = (text or "").strip(" \t\n")[:1024].lower()
        for n in (2, 3, 4):
            for i in range(len(seen) - n + 1):
                slot = vectors.slot_of(seen[i : i + n])
                at = (key, slot % 384)
                want[at] = want.get(at, 0) + (1 if slot < 384 else -1)
    norms = {}
    for (key, _), v in want.items():
        norms[key] = norms.get(key, 0) + v * v
    assert {(r.k, r.idx): r.value for r in made.collect()} == {(k, i): v / math.sqrt(norms[k]) for (k, i), v in want.items() if v}


def test_pairs_in_squares_and_batches_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(D, "FIRST", 16)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)] + ["ALPHA", "beta", "gamma"]
    rows = [(i, i % 2, sorted(set(rng.choices(words, k=rng.randint(0, 5))))) for i in range(200)]
    items = spark.createDataFrame(rows, "id bigint, g int, keywords array<string>")
    like = lambda a, b: _similar(set(a), set(b)) >= D.SIMILARITY
    kept = []
    for i, g, own in rows:
        if not any(rows[j][1] == g and like(own, rows[j][2]) for j in kept):
            kept.append(i)
    assert sorted(r.id for r in D.greedy_kept(items, CORE, by=("g",)).collect()) == kept
    first = {}
    for i, _, own in rows:
        if own:
            first.setdefault(tuple(own), i)
    monkeypatch.setattr(D, "SQUARE", 7)
    want = {(i, first[tuple(own)], sum(like(own, x) for x in first if x != tuple(own))) for i, _, own in rows if own}
    counted = D.link_counts(items, CORE)
    assert {tuple(r) for r in counted.collect()} == want
    best = {}
    for i, _, own in rows:
        near = [(-min(1.0, _similar(set(own), set(o))), j) for j, _, o in rows if j % 3 == 0 and like(own, o)]
        if i % 3 and near:
            best[i] = min(near)[1]
    found = D.similar_to_processed(items.where("id % 3 <> 0"), items.where("id % 3 = 0").withColumnRenamed("id", "seq"), CORE)
    assert {r.id: r.seq for r in found.collect()} == best


def test_top_k_holds_the_cosines_of_some_queries_at_once(spark, monkeypatch):
    import numpy as np

    from curator.operators import vectors

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(40)], "vec_id bigint, embedding array<double>")
    rows = lambda: sorted((r["query"], r["rank"], r["item"], round(r["cosine"], 9)) for r in vectors.cosine_top_k(df, df, 4).collect())
    want = rows()
    monkeypatch.setattr(vectors, "ROWS", 3)
    assert rows() == want and len(want) == 160


def test_rules_run_only_over_texts_with_what_their_hits_begin_with(spark):
    import random
    import re

    assert Y.beginnings("Idiot|scum?") == ["idiot", "scu"] and Y.beginnings(r"password=\w+") == ["password="] and Y.beginnings("a*b|c") is None and Y.beginnings("(a|b)c") is None and Y.beginnings(r"ab|\d") is None
    rules = [Y.Rule("a", "high", "Ask|skip?"), Y.Rule("b", "low", r"key=\w+"), Y.Rule("c", "low", r"\d+"), Y.Rule("d", "low", "!!")]
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ASK", "as\u212a", "a\u017fk", "sKi", "Key=", "KEY=x9", "\u0130", "!", " ", "7", "é"]) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [(f.rule, list(f.found), f.contexts) for f in r.f] for r in df.select("id", Y.findings(F.col("t"), rules, around=None).alias("f")).collect()}
    hits = lambda r, t: re.findall(r.pattern, t or "", re.IGNORECASE | re.ASCII)
    assert got == {i: [(r.name, h, None) for r in rules if (h := hits(r, t))] for i, t in enumerate(texts)}


def test_hashed_ngrams_of_whole_texts_in_pieces(spark, monkeypatch):
    import math

    import pyarrow as pa

    from curator.operators import vectors

    texts = ["", None, "a", "ab", "Naïve 😀 text " * 300, "x" * 64, "y" * 129, "q" * 2000 + "end of it", "short"]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    want = {}
    for key, text in rows:
        seen = (text or "").lower().strip()
        for n in (2, 3, 4):
            for i in range(len(seen) - n + 1):
                slot = vectors.slot_of(seen[i : i + n])
                want[key, slot % 384] = want.get((key, slot % 384), 0) + (1 if slot < 384 else -1)
    norms = {}
    for (key, _), v in want.items():
        norms[key] = norms.get(key, 0) + v * v
    want = {(k, i): v / math.sqrt(norms[k]) for (k, i), v in want.items() if v}
    made = vectors.hashed_ngrams(spark.createDataFrame(rows, "k bigint, t string"), "k", F.col("t"), most=None)
    assert {(r.k, r.idx): r.value for r in made.collect()} == want
    monkeypatch.setattr(vectors, "PIECE", 64)
    monkeypatch.setattr(vectors, "TOGETHER", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t and t.lower().strip() for _, t in rows])], ["_v_key", "t"])
    parts = [p.to_pydict() for p in vectors._components(iter([batch]), 384)]
    assert {(k, i): v for p in parts for k, i, v in zip(p["_v_key"], p["idx"], p["value"])} == want


def test_vectors_use_the_ends_of_long_texts(spark, tmp_path):
    from curator import plans

    rows = [(1, "word " * 500), (2, "word " * 500 + "zebra")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = {1: set(), 2: set()}
    for r in plans.QUERIES["hash_vectors"](spark, str(tmp_path)).collect():
        made[r.doc_id].add((r.idx, r.value))
    assert made[1] != made[2]


def test_similar_titles_are_all_pairs_with_their_similarity(spark, monkeypatch):
    from curator import plans

    rng = random.Random(9)
    words = [f"w{i}" for i in range(9)] + ["ALPHA", "beta", "gamma"]
    rows = [(i, sorted(set(rng.choices(words, k=rng.randint(0, 5))))) for i in range(200)]
    first = {}
    for i, own in rows:
        if own:
            first.setdefault(tuple(own), i)
    want = {(first[x], first[y], round(_similar(set(x), set(y)), 9)) for x in first for y in first if first[x] < first[y] and _similar(set(x), set(y)) >= D.SIMILARITY}
    items = spark.createDataFrame(rows, "id bigint, keywords array<string>")
    for square in (2048, 7):
        monkeypatch.setattr(D, "SQUARE", square)
        got = [(r.a, r.b, round(r.sim, 9)) for r in D.similar_titles(items, CORE).collect()]
        assert len(got) == len(want) and set(got) == want
    assert plans.QUERIES["title_similarity_pairs"](spark, "/root/testdata/sf0.001").columns == ["a", "b", "sim"]


def test_batches_of_a_scan_take_keys_of_two_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "FIRST", 16)
    rng = random.Random(4)
    rows = [(i // 7, -i, i % 2, sorted(set(rng.choices([f"w{n}" for n in range(9)], k=rng.randint(0, 5))))) for i in range(200)]
    kept = []
    for row in sorted(rows):
        if not any(row[2] == x[2] and _similar(set(row[3]), set(x[3])) >= D.SIMILARITY for x in kept):
            kept.append(row)
    items = spark.createDataFrame(rows, "age bigint, id bigint, g int, keywords array<string>").withColumn("place", F.struct("age", "id"))
    assert sorted(r.place.id for r in D.greedy_kept(items, CORE, "place", by=("g",)).collect()) == sorted(x[1] for x in kept)
