"""Links, titles and embedded JSON of raw pages, feeds, and review files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import bound
from ..functions.links import web_link


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, place, href, title) of every anchor in page order."""
    pattern = r"(?is)<a\s[^>]*?href=[\"']?([^\"'>\s]*)[\"']?[^>]*>(.*?)</a>"
    every = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    rows = pages.select(key, url, F.posexplode(every).alias("place", "a"))
    title = F.trim(F.regexp_replace(F.regexp_replace("a.inner", r"<[^>]*>", ""), r"\s+", " "))
    return rows.select(key, url, F.col("place").cast("bigint").alias("place"), F.col("a.href").alias("href"), title.alias("title"))


def links(pages: DataFrame, least_title: int, accept: str, most: int | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The link source that all crawlers share (links to other things than web pages are none): titles of some length, absolute URLs that a rule accepts, each once per page, the first `most`."""
    fit = bound(anchors(pages, key, url, html).where((F.col("href") != "") & (F.length("title") >= least_title)), "link", web_link(F.col("href"), F.col(url)))
    fit = fit.where(F.col("link").rlike(accept))
    first = F.row_number().over(Window.partitionBy(key, "link").orderBy("place"))
    once = fit.withColumn("_n", first).where("_n = 1").drop("_n")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place")).cast("bigint")
    ranked = once.withColumn("rank", rank)
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select(key, "rank", "link", "title")


@dataclass(frozen=True)
class LinkRule:
    """What a source's list pages take for an item: least length of a title, patterns that a link must and mustn't match, titles that are none, whether the title attribute goes first, where the date stands in a link, most items of a page."""

    source: str
    least_title: int = 10
    accept: str = "."
    reject: str = "(?!)"
    stop_titles: tuple[str, ...] = ()
    attribute_first: bool = False
    date: str = r"/(20\d{2})(\d{2})(\d{2})/"
    most: int = 20


def rule_table(spark: SparkSession, rules: list[LinkRule]) -> DataFrame:
    """A row for each rule; there are as many as sources."""
    schema = "source string, least_title int, accept string, reject string, stop_titles array<string>, attribute_first boolean, date string, most int"
    return spark.createDataFrame([(r.source, r.least_title, r.accept, r.reject, list(r.stop_titles), r.attribute_first, r.date, r.most) for r in rules], schema)


def rule_links(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", source: str = "source") -> DataFrame:
    """(source, key, rank, link, title, day) by the rule of each page's source: the first place of each link of the source's pages, in page order, as many as the rule takes of a page.

    Rules, of which there are as many as sources, are broadcast: a join of exchanges would deal all links by the few sources.
    """
    pattern = r"(?is)<a\s([^>]*?href=[\"']?([^\"'>\s]*)[\"']?[^>]*)>(.*?)</a>"
    part = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    every = F.arrays_zip(part(1).alias("attributes"), part(2).alias("href"), part(3).alias("inner"))
    rows = pages.select(source, key, url, F.posexplode(every).alias("place", "a")).where(F.col("a.href") != "").join(F.broadcast(rules), source)
    squeezed = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    own = squeezed(F.regexp_extract("a.attributes", r"(?i)title=[\"']([^\"']*)[\"']", 1))
    shown = squeezed(F.regexp_replace("a.inner", r"<[^>]*>", ""))
    titled = bound(rows, "title", F.when(F.col("attribute_first") & (own != ""), own).otherwise(shown))
    titled = titled.where((F.length("title") >= F.col("least_title")) & ~F.array_contains("stop_titles", F.col("title")))
    fit = bound(titled, "link", web_link(F.col("a.href"), F.col(url))).where(F.regexp("link", F.col("accept")) & ~F.regexp("link", F.col("reject")))
    # the first place of a link is a partial aggregate: a link that every page has is no large group
    kept = F.struct(F.col(key).alias("key"), "place", "title", "most", "date")
    firsts = fit.groupBy(source, "link").agg(F.min(kept).alias("_first")).select(source, "link", F.col("_first.key").alias(key), *[f"_first.{c}" for c in ("place", "title", "most", "date")])
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    taken = firsts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= F.col("most"))
    day = F.try_to_date(F.concat_ws("-", *[F.expr(f"regexp_extract(link, date, {i})") for i in (1, 2, 3)]), "yyyy-MM-dd")
    return taken.select(source, key, "rank", "link", "title", day.alias("day"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def embedded_json(html: Column, name: str) -> Column:
    """The text of a script element with this id."""
    return F.regexp_extract(html, rf"(?is)<script[^>]*id=[\"']{name}[\"'][^>]*>(.*?)</script>", 1)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(day, news_id, text) of review files <day>/news_<id>.md under a folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(
        F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/(?:[^/]+/)*(?:\d+-)?news_\d+\.md$", 1), "yyyy-MM-dd").alias("day"), F.regexp_extract("path", r"news_(\d+)\.md$", 1).try_cast("bigint").alias("news_id"), F.col("value").alias("text")
    )


def article_body(html: Column, least: int = 100, most: int = 10_000) -> Column:
    """The text of the article element, else of the paragraphs; null where it is too short, cut where it is too long."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<aside\b.*?</aside>", " ")
    article = F.regexp_extract(shown, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    paragraphs = F.array_join(F.regexp_extract_all(shown, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), " ")
    text = F.regexp_replace(F.when(article != "", article).otherwise(paragraphs), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) > least, F.substring(text, 1, most))


def pdf_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link) of the distinct PDF files that pages link to."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']?([^\"'>\s]+\.pdf)"), F.lit(1)))
    return pages.select(key, url, F.explode(found).alias("href")).select(key, web_link(F.col("href"), F.col(url)).alias("link")).distinct()


def rss_items(feeds: DataFrame, key: str, xml: str, most: int = 20) -> DataFrame:
    """(key, place, title, link, published) of a feed's first items that have a title and a link."""
    rows = feeds.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("place", "item"))
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    when = F.regexp_extract(part("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    items = rows.select(key, "place", part("title").alias("title"), part("link").alias("link"), F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz").alias("published"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return items.where((F.col("title") != "") & (F.col("link") != "")).withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def review_list(files: DataFrame, most: int) -> DataFrame:
    """The newest review files: by day, then by file name as text; with a title and a preview."""
    first = F.regexp_extract("text", r"^#? ?([^\n]*)", 1)
    named = files.withColumn("name", F.concat(F.lit("news_"), F.col("news_id").cast("string"), F.lit(".md")))
    return named.orderBy(F.desc("day"), F.desc("name")).limit(most).select("day", "news_id", first.alias("title"), F.substring("text", 1, 200).alias("preview"))


def latest_reviews(files: DataFrame) -> DataFrame:
    """The text of each item's review in the newest folder that has one."""
    return files.groupBy("news_id").agg(F.max_by("text", "day").alias("text"), F.max("day").alias("day"))


def reviews_of(texts: DataFrame) -> DataFrame:
    """(day, news_id, text, commit) of the review files among texts by day; other files are left out."""
    number = F.regexp_extract("name", r"^news_(\d+)\.md$", 1).try_cast("bigint")
    return texts.select("day", number.alias("news_id"), "text", "commit").where("news_id IS NOT NULL")


def enabled_sources(registry: DataFrame, week: int | None = None) -> DataFrame:
    """Sources that are enabled, up to a week of the roll-out."""
    on = registry.where("enabled")
    return on if week is None else on.where(F.col("week") <= week)
