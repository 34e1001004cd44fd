"""Lexicons as tables against plain containment."""

import random

from curator.functions import lexicon as K
from curator.operators.state import pending
from curator.operators.terms import HEAD, PIECE, term_counts, terms_found
from curator.plans import scoring
from pyspark.sql import functions as F


def _rows(spark, texts, terms):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string")
    return items, spark.createDataFrame(terms, "criterion string, score bigint, term string")


def test_found_terms_are_those_that_a_text_contains(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé😀\n?") for _ in range(n))
    texts = [word(n) for n in [0, 1, 2, 3, 50, 300, PIECE - 1, PIECE, PIECE + 1, 3 * PIECE + 7]] + [None, "abc", "abc"]
    terms = sorted({(f"g{rng.randrange(3)}", rng.randrange(5), word(rng.randrange(1, 9))) for _ in range(300)})
    items, lexicon = _rows(spark, texts, terms + terms[:9] + [("g0", 1, None), ("g0", 1, ""), (None, None, "ab")])
    got = {(r.id, r.criterion, r.score, r.term) for r in terms_found(items, lexicon, by=("criterion", "score")).collect()}
    assert got == {(i, g, s, t) for i, text in enumerate(texts) if text for g, s, t in [*terms, (None, None, "ab")] if t in text}


def test_a_term_over_the_border_of_two_pieces_counts_once(spark):
    term = "x" + "y" * (HEAD + 30)
    items, lexicon = _rows(spark, ["-" * (PIECE - 5) + term + "-" * PIECE, "-" * (2 * PIECE - 1) + term, "-" * PIECE + term[:-1]], [("a", 7, term), ("a", 9, "x")])
    rows = {(r.id, r.n, r.best) for r in term_counts(terms_found(items, lexicon, by=("criterion", "score"))).collect()}
    assert rows == {(0, 2, 9), (1, 2, 9), (2, 1, 9)}


def test_empty_tables_and_other_columns(spark):
    items, lexicon = _rows(spark, ["abc"], [("a", 1, "b")])
    assert terms_found(items.limit(0), lexicon).count() == 0
    assert terms_found(items, lexicon.limit(0)).count() == 0
    clashing = items.withColumns({"term": F.lit("b"), "head": F.lit("x"), "_window": F.lit(1)})
    assert [tuple(r) for r in terms_found(clashing, lexicon).collect()] == [(0, "b")]


def test_a_large_lexicon_stays_out_of_the_plan_and_in_generated_code(spark, sf_dir):
    df = scoring.large_lexicon_scores(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert len(plan) < 20_000


def test_a_lexicon_beyond_the_broadcast_threshold_gives_the_same(spark, sf_dir):
    want = {tuple(r) for r in scoring.large_lexicon_scores(spark, sf_dir).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r) for r in scoring.large_lexicon_scores(spark, sf_dir).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exempt_sources_pass_administrative_terms_but_not_opinions(spark):
    rows = [("ministry", "plan issued by the office"), ("paper", "plan issued by the office"), ("ministry", "an opinion"), (None, "plan issued by the office"), (None, "growth")]
    items = spark.createDataFrame(rows, "source string, text string")
    gate = lambda sources: [r[0] for r in items.select(K.factual(F.col("text"), ["opinion"], ["issued"], K.exempt(F.col("source"), sources))).collect()]
    assert gate(["ministry"]) == [True, False, False, False, True]
    assert gate([]) == [False, False, False, False, True]


def test_a_notice_has_all_terms_in_its_title(spark):
    rows = [("a", "issued by office 12"), ("a", "issued, a long title without the other"), ("b", "issued by office 12")]
    items = spark.createDataFrame(rows, "source string, title string")
    col = K.analytical(F.col("title"), F.col("title"), ["issued", "office"], r"\d", [], K.exempt(F.col("source"), ["b"]))
    assert [r[0] for r in items.select(col).collect()] == [False, True, True]


def test_richness_counts_the_length_of_the_content(spark):
    row = spark.createDataFrame([("t" * 600, "c" * 40), ("t", "c" * 600), ("t" * 80, "c" * 99)], "title string, content string")
    col = K.fact_richness(F.concat("title", "content"), F.col("content"), [r"\d"], [])
    assert [r[0] for r in row.select(col).collect()] == [-15, 3, -5]


def test_pending_rows_are_the_newest_in_batches(spark):
    items = spark.range(100).withColumn("waits", F.col("id") % 2 == 0)
    rows = [tuple(r) for r in pending(items, F.col("waits"), most=25, each=10).select("id", "batch").collect()]
    assert sorted(rows, reverse=True) == [(98 - 2 * i, i // 10) for i in range(25)]
    assert pending(items.limit(0), F.col("waits")).count() == 0


def test_every_way_finds_the_same_and_none_of_a_small_lexicon_shuffles_windows(spark, monkeypatch):
    from curator.operators import terms as module

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé😀\n") for _ in range(n))
    texts = [word(n) for n in [0, 1, 5, 40, 2 * PIECE + 3]] + [None]
    terms = sorted({("g", 1, word(rng.randrange(1, 12))) for _ in range(80)})
    items, lexicon = _rows(spark, texts, terms)
    want = {(i, t) for i, text in enumerate(texts) if text for _, _, t in terms if t in text}
    for few, most, join in [(300, 1 << 20, "BroadcastNestedLoopJoin"), (0, 1 << 20, "BroadcastHashJoin"), (0, 0, None)]:
        monkeypatch.setattr(module, "FEW", few)
        monkeypatch.setattr(module, "BROADCAST", most)
        found = terms_found(items, lexicon, by=("criterion",))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.term) for r in found.collect()} == want
        assert join is None or (join in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan)


def test_runs_of_letters_are_looked_up_and_found_pairs_stay_where_they_are(spark, monkeypatch):
    """Some hundred terms inside runs, and some that aren't: frequent runs by table, others by search; what is found isn't shuffled by term."""
    from curator.operators import terms as T

    monkeypatch.setattr(T, "KNOWN", 40)
    monkeypatch.setattr(T, "SHARE", 2)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcAB1") for _ in range(n))
    common = [word(5) for _ in range(60)]
    texts = [rng.choice([" ", "-", "é", "\n"]).join([*rng.choices(common, k=30), *(word(rng.randrange(1, 9)) for _ in range(9)), word(1500)]) for _ in range(60)] + [None, "", " "]
    terms = sorted({(f"g{rng.randrange(3)}", rng.randrange(5), word(rng.randrange(2, 7))) for _ in range(500)} | {("odd", 1, t) for t in ("a ", "é", "b\n", "A-b", "1 a")})
    assert len(terms) > T.FEW
    items, lexicon = _rows(spark, texts, terms)
    found = terms_found(items, lexicon, by=("criterion", "score"))
    assert {tuple(r) for r in found.collect()} == {(i, g, s, t) for i, text in enumerate(texts) if text for g, s, t in terms if t in text}
    assert found.count() == found.distinct().count()
    plan = term_counts(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(_key") > 0
