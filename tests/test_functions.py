"""Links and JSON in free text, against the standard library."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from curator.functions import text as X
from curator.functions.links import resolved, web_link
from curator.sources import pages as P

BASES = ["http://h.com/a/b.html", "http://h.com", "http://h.com/", "https://H.com/a/b/?q=1#top", "http://h.com/a//b/c", "http://u:p@h.com:80/x/y;z?x=/../y", "http://h.com/a/../b/"]
REFERENCES = [
    "p.html", "../p.html", "../../../p", "./p", "./", "..", "../", "", "#f", "?q=2", "?", "#", "/x/y", "/x/../y/./z", "//o.com/p", "//o.com", "HTTP://Q.com/x", "https://q.com/../x", "javascript:void(0)",
    "mailto:a@b.c", "g;x=1/../y", "g?y/./x", "g#s/../x", "a//b", "/a//b", " p", "/..", "/.", "a/..", "a/.", "b/../..", "http:g", "é/ü?ñ", "...", "..g", "g..", "a b", "p?x=http://y.com/", "JAVASCRIPT:x",
    "data:text/html,x", "tel:+1", "/?q", "/#f", "x:y", "1:2", "p\n.html", "\t../q",
]


def test_links_are_resolved_as_by_urljoin(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFERENCES], "base string, href string")
    got = df.select("base", "href", resolved(F.col("href"), F.col("base")).alias("link"), web_link(F.col("href"), F.col("base")).alias("web")).collect()
    assert len(got) == len(BASES) * len(REFERENCES)
    for r in got:
        want = urljoin(r.base, r.href)
        assert r.link == want, (r.base, r.href)
        assert r.web == (want if want.lower().startswith(("http://", "https://")) else None), (r.base, r.href)


def test_links_of_pages_are_resolved_as_by_urljoin(spark, sf_dir):
    from curator.sources import pages as P

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = P.anchors(pages).withColumn("link", web_link(F.col("href"), F.col("url"))).collect()
    assert found and all(r.link == urljoin(r.url, r.href) for r in found)


def test_null_links(spark):
    row = spark.createDataFrame([(None, "x"), ("http://a/", None)], "base string, href string").select(web_link(F.col("href"), F.col("base")).alias("l")).collect()
    assert [r.l for r in row] == [None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('So {"recipes": [{"a": "}"}]} and then {"b": 2}', {"recipes": [{"a": "}"}]}),
        ("x } {", None),
        ('{"a": "\\"}{"} tail}', {"a": '"}{'}),
        ("none", None),
        ('} {"a": {"b": [{}, {"c": {}}]}} }', {"a": {"b": [{}, {"c": {}}]}}),
        ('{"open": {"x": 1}', None),
        ('{"a": "\\\\"} }', {"a": "\\"}),
        (None, None),
        ("", None),
        ('{"long": "' + "{" * 20_000 + '"}', {"long": "{" * 20_000}),
    ],
)
def test_first_object(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(X.first_object(F.col("s")).alias("j")).first().j
    assert (None if got is None else json.loads(got)) == want


def test_fenced_objects(spark):
    texts = ['{"a": 0} ```json\n{"a": {"b": 1}} and }\n```', '```\n[1]\n``` {"a": 2}', 'say {"a": 3}.', "nothing"]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "s string").select(X.fenced_json(F.col("s")).alias("j")).collect()]
    assert got == ['{"a": {"b": 1}}', "[1]", '{"a": 3}', None]
    named = [r.j for r in spark.createDataFrame([(t,) for t in texts], "s string").select(X.answered(F.col("s"), "a").alias("j")).collect()]
    assert named == ['{"b":1}', "2", "3", None]


def _copies(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_texts_and_links_are_computed_once(spark, sf_dir):
    """An expression that is named in many places is copied to each, and those of the copies' parts multiply."""
    from curator.plans import QUERIES

    text = F.reverse("s")
    df = spark.createDataFrame([("}1 :\"a\"{ ees",)], "s string")
    for f in (X.first_object, X.fenced_json, lambda t: X.answered(t, "a")):
        assert _copies(df.select(f(text).alias("j")), "reverse(") == 1
    assert df.select(X.first_object(text).alias("j")).first().j == '{"a": 1}'
    links = spark.createDataFrame([("c.x", "b/a//:ptth")], "h string, b string").repartition(2).select(web_link(F.reverse("h"), F.concat("b", F.lit(""))).alias("link"))
    assert _copies(links, "reverse(") == 1
    assert _copies(QUERIES["parsed_answers"](spark, sf_dir), "from_json(") <= 1 and _copies(QUERIES["parsed_answers"](spark, sf_dir), "to_json(") <= 1


def test_objects_of_any_depth(spark):
    """The pattern reads a few levels, the fold the others and what isn't closed."""
    deep = '{"a": ' * 12 + '"}\\"{"' + "}" * 12
    texts = [f"so {deep} }}", deep[:-1], "{" * 5000 + "}" * 5000 + "}", '{"a": "' + '\\"}' * 20000 + '"} {', "}{", "no } object", '{"a": {"b": {"c": {"d": {"e": {}}}}}} {}']
    want = [deep, None, "{" * 5000 + "}" * 5000, texts[3][:-2], None, None, texts[6][:-3]]
    assert [r.j for r in spark.createDataFrame([(t,) for t in texts], "s string").select(X.first_object(F.col("s")).alias("j")).collect()] == want


def test_a_link_of_every_page_is_no_large_group(spark):
    """The first place of each link is aggregated before rows are dealt by link: no window over all places of one."""
    rules = P.rule_table(spark, [P.LinkRule("a", 1), P.LinkRule("b", 1, most=1)])
    html = "<a href='/home'>home</a><a href='/{0}'>own {0}</a><a href='/home'>again</a><a href='/x{0}'>other</a>"
    pages = spark.createDataFrame([("ab"[i % 2], i, "http://h/", html.format(i)) for i in range(40, 0, -1)], "source string, page_id bigint, url string, html string")
    found = P.rule_links(pages, rules)
    got = sorted(tuple(r) for r in found.collect())
    want = [("a", 2, 1, "http://h/home", "home", None), ("a", 2, 2, "http://h/2", "own 2", None), ("a", 2, 3, "http://h/x2", "other", None)]
    want += [("a", i, k, f"http://h/{s}{i}", t, None) for i in range(4, 41, 2) for k, s, t in ((1, "", f"own {i}"), (2, "x", "other"))]
    want += [("b", 1, 1, "http://h/home", "home", None)] + [("b", i, 1, f"http://h/{i}", f"own {i}", None) for i in range(3, 41, 2)]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(page_id" in plan and "windowspecdefinition(source" not in plan
