import datetime
import random

import pytest
from pyspark.sql import functions as F

from curator.functions import text as X
from curator.operators import state as S
from curator.schema import NEWS, REVIEWS, evolved
from curator.sources import commits as C
from curator.sources import pages as P


def test_feed_items(spark):
    xml = "<rss><item><title><![CDATA[A & b]]></title><link>http://a/1</link><pubDate>Mon, 05 Feb 2024 10:11:12 GMT</pubDate></item><item><title>no link</title></item><item><title>B</title><link>http://a/2</link></item></rss>"
    got = P.rss_items(spark.createDataFrame([(1, xml)], "k int, xml string"), "k", "xml").orderBy("place").collect()
    assert [(r.title, r.link) for r in got] == [("A & b", "http://a/1"), ("B", "http://a/2")]
    assert got[0].published == datetime.datetime(2024, 2, 5, 10, 11, 12) and got[1].published is None
    assert P.rss_items(spark.createDataFrame([(1, xml)], "k int, xml string"), "k", "xml", most=1).count() == 1


def test_pdf_links(spark):
    html = "<a href='/a.pdf'>x</a><a href=\"http://b.example/c.PDF\">y</a><a href='/a.pdf'>z</a><a href='d.html'>w</a>"
    got = P.pdf_links(spark.createDataFrame([(1, "http://a.example/p", html)], "page_id int, url string, html string")).collect()
    assert {r.link for r in got} == {"http://a.example/a.pdf", "http://b.example/c.PDF"}


def test_reviews_reports_and_backups(spark, tmp_path):
    docs = spark.createDataFrame([("2024-01-02", 9, "# old\ntext"), ("2024-01-03", 10, "# ten\nx"), ("2024-01-03", 9, "# new\ny")], "d string, news_id bigint, text string")
    docs = docs.select(F.to_date("d").alias("day"), "news_id", "text")
    got = P.review_list(docs, 2).collect()
    assert [(r.news_id, r.title) for r in got] == [(9, "new"), (10, "ten")]  # by name as text
    assert {r.news_id: r.text for r in P.latest_reviews(docs).collect()}[9].startswith("# new")
    C.write_report({"all": docs, "counts": docs.groupBy("day").count()}, str(tmp_path / "report"), "2024-01-03")
    assert C.read_sheet(spark, str(tmp_path / "report"), "counts").count() == 2


def test_schemas_evolve(spark):
    out = evolved(spark.createDataFrame([(1,)], "id bigint"), NEWS)
    assert out.columns == NEWS.fieldNames() and len(NEWS) == 31 and len(REVIEWS) == 16


def test_relative_times(spark):
    now = datetime.datetime(2024, 2, 1)
    said = ["just now", "3 minutes ago", "2 hours ago", "1 day ago", "2024-01-05", "2024-01-05 06:07", "soon"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(X.relative_time(F.col("s"), F.lit(now).cast("timestamp_ntz")).alias("t")).collect()
    assert [r.t for r in got] == [
        now, now - datetime.timedelta(minutes=3), now - datetime.timedelta(hours=2), now - datetime.timedelta(days=1), datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 5, 6, 7), None,
    ]


def test_replay_and_safe_html(spark):
    log = spark.createDataFrame([(1, 1, "go"), (1, 2, "nonsense"), (1, 3, "stop"), (2, 1, "stop")], "k int, at int, e string")
    got = S.replayed(log, "k", "e", ["at"], "idle", {("idle", "go"): "busy", ("busy", "stop"): "idle", ("busy", "go"): "busy"}).collect()
    assert {r.k: r.state for r in got} == {1: "idle", 2: "idle"}
    row = spark.range(1).select(X.safe_html(F.lit("<p onclick=x>a<script>bad()</script><u>b</u></p>")).alias("h"), X.safe_html(F.lit("a\nb")).alias("t")).first()
    assert (row.h, row.t) == ("<p>ab</p>", "a<br>b")


def test_replay_of_keys_of_any_size(spark):
    """A key of most rows is folded in runs over several levels; null keys, null events and an empty log."""
    chance = random.Random(3)
    moves = {("a", "x"): "b", ("b", "x"): "c", ("c", "y"): "a", ("b", "y"): "a", ("a", "z"): "c"}
    rows = [(1 if chance.random() < 0.8 else chance.choice([2, 3, 4, None]), at, chance.choice(["x", "y", "z", "no", None])) for at in range(3000)]
    want = {}
    for k, _, e in rows:
        s = want.get(k, "a")
        want[k] = moves.get((s, e), s)
    chance.shuffle(rows)
    log = spark.createDataFrame(rows, "k int, at int, e string").repartition(5)
    for piece in (4, 64, 1024):
        assert {r.k: r.state for r in S.replayed(log, "k", "e", ["at"], "a", moves, piece).collect()} == want
    assert S.replayed(log.limit(0), "k", "e", ["at"], "a", moves).count() == 0


def test_rule_links(spark):
    html = (
        '<a href="/x/20240203/a.html" title="The title attribute">short</a><a href="/x/20240203/a.html">The same link again</a><a href="/x/20249903/b.html">A title of some length</a>'
        '<a href="/video/20240204/c.html">A title of some length</a><a href="/x/20240205/d.html">Read more here</a><a href="/x/20240206/e.html">tiny</a><a href="/y.pdf">A title of some length</a><a href="/x/20240207/f.html">One too many links</a>'
    )
    rule = P.LinkRule("s", 10, r"/20\d+/\w\.html$", "/video/", ("Read more here",), True, most=2)
    pages = spark.createDataFrame([("s", 1, "http://a.example/p", html), ("none", 2, "http://b.example/p", html), ("s", 3, "http://a.example/q", None)], "source string, page_id int, url string, html string")
    got = P.rule_links(pages, P.rule_table(spark, [rule])).orderBy("rank").collect()
    assert [(r.page_id, r["rank"], r.link[-8:], r.title, str(r.day)) for r in got] == [(1, 1, "3/a.html", "The title attribute", "2024-02-03"), (1, 2, "3/b.html", "A title of some length", "None")]


def test_backups_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path)
    assert C.backups(spark, path).collect() == []
    for n, stamp in ((3, "20240101"), (5, "20240103"), (0, "20240102")):
        C.backup(spark.range(n), path, stamp)
    # a snapshot that was never committed is newer than all, and isn't seen
    spark.range(99).write.parquet(f"{path}/20240109/abc/data")
    assert C.restored(spark, path).count() == 5 and C.restored(spark, path, "20240101").count() == 3 and C.restored(spark, path, "20240102").count() == 0
    assert C.restored(spark, path).columns == ["id"]
    with pytest.raises(ValueError, match="no whole set 20240109"):
        C.restored(spark, path, "20240109")
    assert [(r.stamp, r.n_rows) for r in C.backups(spark, path).collect()] == [("20240103", 5), ("20240102", 0), ("20240101", 3)]
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error("on purpose")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="on purpose"):
        C.backup(bad, path, "20240103")
    assert C.restored(spark, path, "20240103").count() == 5  # as it was
    C.backup(spark.range(6), path, "20240103")
    assert C.restored(spark, path).count() == 6
    assert C.sweep(spark, path) == 3 and C.restored(spark, path).count() == 6
    assert C.expire_backups(spark, path, "20240109") == ["20240101", "20240102"]
    assert [r.stamp for r in C.backups(spark, path).collect()] == ["20240103"]
    C.backup(spark.range(1), path, "20240101")  # a stamp that went can come again
    assert C.restored(spark, path, "20240101").count() == 1


def test_a_report_replaces_its_day(spark, tmp_path):
    path, sheet = str(tmp_path), spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    C.write_report({"one": sheet, "two": sheet.limit(1)}, path, "2024-01-01")
    C.write_report({"one": sheet.where("n = 2"), "two": sheet}, path, "2024-01-01")
    C.write_report({"one": sheet.limit(0), "two": sheet}, path, "2023-12-31")
    assert [tuple(r) for r in C.read_sheet(spark, path, "one", schema="n int, t string").collect()] == [(2, None)]
    assert C.read_sheet(spark, path, "two").count() == 2 and C.read_sheet(spark, path, "one", "2023-12-31", "n int, t string").count() == 0
