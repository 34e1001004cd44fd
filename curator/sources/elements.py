"""The element tree of pages as rows, and bodies by a table of selectors.

A page becomes pieces: each begins with a tag and goes on with the text behind it. A running count of open elements of
the same name gives each start tag the end tag that closes it, so an element is a range of pieces, and what lies in it is
what stands between. Each page's pieces are ordered by a window within the page; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Elements without an end tag, and those whose inside is not a body's text (fixed values of HTML and of the rule for bodies).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HIDDEN = ("script", "style", "nav", "footer", "aside")
#: Elements that text flows through; others begin a line.
INLINE = ("a", "abbr", "b", "code", "em", "font", "i", "mark", "small", "span", "strong", "sub", "sup", "u")


@dataclass(frozen=True)
class Selector:
    """Elements of a source's pages by name, class (all words of it) and id, in order of preference; source "" is for all."""

    source: str
    rank: int
    tag: str
    classes: str = ""
    id: str = ""


def selector_table(spark: SparkSession, selectors: list[Selector]) -> DataFrame:
    rows = [(s.source, s.rank, s.tag, s.classes.split(), s.id) for s in selectors]
    return spark.createDataFrame(rows, "sel_source string, sel_rank int, sel_tag string, sel_classes array<string>, sel_id string")


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted in either way or not at all; empty if there is none."""
    part = lambda i: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", i)
    return F.concat(part(1), part(2), part(3))


def pieces(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, at, name, kind, tag, text): kind is 1 for a start tag, -1 for an end tag and 0 for others; comments are gone, what scripts and styles hold is no markup."""
    shown = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    shown = F.regexp_replace(shown, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|\z)", "$1$3")
    every = F.posexplode(F.split(shown, r"(?=</?[A-Za-z!])"))
    tag = F.regexp_extract("piece", r"(?s)^(<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)
    rows = pages.select(F.col(key).alias("_page"), every.alias("at", "piece")).withColumn("tag", tag)
    name = F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
    rows = rows.withColumn("name", name).withColumn("text", F.expr("substring(piece, length(tag) + 1)"))
    kind = F.when(F.col("tag").startswith("</"), -1).when((F.col("name") == "") | F.col("name").isin(*VOID) | F.col("tag").endswith("/>"), 0).otherwise(1)
    return rows.select("_page", "at", "name", kind.alias("kind"), "tag", "text")


def elements(parts: DataFrame) -> DataFrame:
    """(_page, at, end, name, tag) of every element: pieces at <= i < end are inside. One that is never closed reaches to the page's end (end is null)."""
    own = parts.where("kind <> 0")
    by_name = Window.partitionBy("_page", "name").orderBy("at")
    depth = F.sum("kind").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    # an end tag that closes nothing takes the count below what it was: counting from the least depth so far keeps it at zero
    own = own.withColumn("_depth", depth)
    floor = F.least(F.min("_depth").over(by_name.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    own = own.withColumn("_level", F.col("_depth") - floor - F.when(F.col("kind") == 1, 1).otherwise(0))
    same_level = Window.partitionBy("_page", "name", "_level").orderBy("at")
    own = own.withColumn("_next", F.lead("kind").over(same_level)).withColumn("_at", F.lead("at").over(same_level))
    return own.where("kind = 1").select("_page", "at", F.when(F.col("_next") == -1, F.col("_at")).alias("end"), "name", "tag")


def _references(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _line_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: the pieces' texts in order, a line for each block, without blank ones."""
    line = F.when(F.col("name").isin(*INLINE), F.col("text")).otherwise(F.concat(F.lit("\n"), F.col("text")))
    joined = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " ")))
    return joined.select(*keys, _references(F.array_join(F.filter(lines, lambda x: x != ""), "\n")).alias("text"))


def bodies(pages: DataFrame, selectors: DataFrame, least: int = 100, most: int = 10_000, key: str = "page_id", html: str = "html", source: str = "source") -> DataFrame:
    """(key, rank, body): what the first selector of the page's source finds whose text is long enough, else the paragraphs (rank is null); null if that is too short as well.

    Each selector looks at the first element it fits. Scripts, menus, footers and sidebars don't count; a body of more
    than `most` characters is cut there.
    """
    parts = pieces(pages.select(key, html), key, html)
    tree = elements(parts)
    hidden = tree.where(F.col("name").isin(*HIDDEN)).select("_page", F.col("at").alias("_from"), F.col("end").alias("_to"))
    marks = hidden.select("_page", F.col("_from").alias("at"), F.lit(1).alias("_in")).unionByName(hidden.where("_to IS NOT NULL").select("_page", F.col("_to").alias("at"), F.lit(-1).alias("_in")))
    inside = parts.join(marks.groupBy("_page", "at").agg(F.sum("_in").alias("_in")), ["_page", "at"], "left")
    shown = inside.withColumn("_hidden", F.sum(F.coalesce("_in", F.lit(0))).over(Window.partitionBy("_page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    shown = shown.where("_hidden = 0").select("_page", "at", "name", "text")

    named = tree.withColumns({"_classes": F.split(F.trim(attribute(F.col("tag"), "class")), r"\s+"), "_id": attribute(F.col("tag"), "id")})
    named = named.join(pages.select(F.col(key).alias("_page"), F.col(source).alias("_source")), "_page")
    fits = (
        (F.col("name") == F.col("sel_tag")) & F.col("sel_source").isin("", F.col("_source")) & (F.size(F.array_except("sel_classes", "_classes")) == 0)
        & ((F.col("sel_id") == "") | (F.col("sel_id") == F.col("_id")))
    )
    # as many selectors as sources have places for them: a few rows for each
    found = named.join(selectors, fits)
    rank = F.struct(F.col("sel_source") == "", "sel_rank")
    first = found.withColumn("_rank", rank).groupBy("_page", "_rank").agg(F.min(F.struct("at", "end")).alias("e")).select("_page", "_rank", F.col("e.at").alias("_from"), F.col("e.end").alias("_to"))
    within = shown.join(first, "_page").where("at >= _from AND (_to IS NULL OR at < _to)")
    texts = _line_text(within.select("_page", "_rank", "at", "name", "text"), ["_page", "_rank"]).where(F.length("text") > least)
    best = texts.groupBy("_page").agg(F.min(F.struct("_rank", "text")).alias("b")).select("_page", F.col("b._rank.sel_rank").alias("rank"), F.col("b.text").alias("body"))

    closed = tree.where("name = 'p'").select("_page", F.col("at").alias("_from"), F.coalesce("end", F.col("at") + 1).alias("_to"))
    # paragraphs don't nest: of each piece only the last one that began before it can hold it
    begun = F.last(F.when(F.col("_p") == 1, F.col("at")), True).over(Window.partitionBy("_page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    starts = closed.select("_page", F.col("_from").alias("at"), F.lit(1).alias("_p"), "_to")
    piece = shown.join(starts, ["_page", "at"], "left").withColumn("_begun", begun)
    reach = F.last("_to", True).over(Window.partitionBy("_page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    piece = piece.withColumn("_reach", reach).where("_begun IS NOT NULL AND at < _reach")
    paragraphs = _line_text(piece.select("_page", "_begun", "at", F.lit("span").alias("name"), "text"), ["_page", "_begun"]).where(F.length("text") > 20)
    joined = paragraphs.groupBy("_page").agg(F.sort_array(F.collect_list(F.struct("_begun", "text"))).alias("ps"))
    fallback = joined.select("_page", F.array_join(F.transform("ps", lambda x: x["text"]), "\n").alias("_plain")).where(F.length("_plain") > least)
    out = pages.select(F.col(key).alias("_page")).join(best, "_page", "left").join(fallback, "_page", "left")
    return out.select(F.col("_page").alias(key), "rank", F.substring(F.coalesce("body", "_plain"), 1, most).alias("body"))
