"""Review files and feeds by day, reports and backups: written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NEWS, evolved
from ..sources import commits as C
from ..sources import daily as Y
from ..sources import pages as P
from ..sources.scratch import root
from ..sources.tables import table
from .registry import query


def _folder(spark, name):
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


#: Reviews as files: a day of five for each, a second version two days later for every third, and a re-run of one day with even ids alone.
_FILES_SQL = """r AS (SELECT doc_id AS news_id, 'item ' || doc_id || CASE WHEN quality = 1 THEN ' good' ELSE ' poor' END AS title, toxic FROM labels),
    f AS (SELECT news_id, DATE '2024-01-01' + (news_id % 5)::INT AS day, title, 'first' AS version FROM r UNION ALL SELECT news_id, DATE '2024-01-03' + (news_id % 5)::INT, title, 'second' FROM r WHERE news_id % 3 = 0),
    files AS (SELECT * FROM f WHERE day <> DATE '2024-01-03' UNION ALL SELECT news_id, day, title, 'again' FROM f WHERE day = DATE '2024-01-03' AND news_id % 2 = 0)"""


def _review_files(spark, sf_dir):
    """The folder of these files, in two writes: all days, then one of them once more."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("news_id"), F.concat(F.lit("item "), F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, " good").otherwise(" poor")).alias("title"))
    day = lambda first: F.date_add(F.lit(first).cast("date"), (F.col("news_id") % 5).cast("int"))
    every = own.select("news_id", day("2024-01-01").alias("day"), "title", F.lit("first").alias("version")).unionByName(
        own.where("news_id % 3 = 0").select("news_id", day("2024-01-03").alias("day"), "title", F.lit("second").alias("version"))
    )
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n## Comment\n"), F.col("version"))
    name = F.concat(F.lit("news_"), F.col("news_id").cast("string"), F.lit(".md"))
    texts = every.select("day", name.alias("name"), text.alias("text"), "news_id", "title")
    stray = spark.createDataFrame([("notes.txt",), ("news_x.md",)], "name string").select(F.lit("2024-01-02").cast("date").alias("day"), "name", F.lit("not a review").alias("text"))
    path = _folder(spark, "reviews")
    Y.write_texts(texts.select("day", "name", "text").unionByName(stray), path)
    again = texts.where("day = DATE'2024-01-03' AND news_id % 2 = 0").withColumn("text", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n## Comment\nagain")))
    Y.write_texts(again, path, replace=True)
    return path


@query(f"""WITH {_FILES_SQL}, l AS (SELECT day, news_id, title, '# ' || title || chr(10) || chr(10) || '## Comment' || chr(10) || version AS preview FROM files QUALIFY row_number() OVER (ORDER BY day DESC, 'news_' || news_id || '.md' DESC, version) <= 50)
    SELECT day, news_id, title, preview FROM l""")
def newest_reviews(spark, sf_dir):
    """The newest files by folder, then by name as text (the list's length is the feature)."""
    return P.review_list(P.reviews_of(Y.read_texts(spark, _review_files(spark, sf_dir))), 50)


@query(f"""WITH {_FILES_SQL} SELECT news_id, max(day) AS day, arg_max('# ' || title || chr(10) || chr(10) || '## Comment' || chr(10) || version, day) AS text FROM files GROUP BY news_id""")
def review_of_each_item(spark, sf_dir):
    """Each item's review in the newest folder that has one; a day that was written again counts as it is now."""
    return P.latest_reviews(P.reviews_of(Y.read_texts(spark, _review_files(spark, sf_dir)))).select("news_id", "day", "text")


@query(f"WITH {_FILES_SQL} SELECT day, count(*)::BIGINT AS n, min(news_id) AS first, sum((version = 'again')::INT)::BIGINT AS again FROM files WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-03' GROUP BY day")
def reviews_of_two_days(spark, sf_dir):
    """A filter on days that the source takes: files of other days aren't opened."""
    own = P.reviews_of(Y.read_texts(spark, _review_files(spark, sf_dir)).where(F.col("day").between(F.lit("2024-01-02").cast("date"), F.lit("2024-01-03").cast("date"))))
    return own.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("news_id").alias("first"), F.sum(F.col("text").endswith("again").cast("bigint")).alias("again"))


@query(f"WITH {_FILES_SQL}, a AS (SELECT 1 AS commit, * FROM f UNION ALL SELECT 2, * FROM files WHERE version = 'again') SELECT news_id, day, max(commit)::BIGINT AS commit, count(*)::BIGINT AS times FROM a GROUP BY news_id, day")
def review_stream(spark, sf_dir):
    """The same files as a stream: each write once, of a day that is written twice both."""
    path, target = _review_files(spark, sf_dir), _folder(spark, "review-stream")
    rows = P.reviews_of(Y.stream_texts(spark, path)).select("day", "news_id", "commit")
    rows.writeStream.format("parquet").option("path", f"{target}/table").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("day date, news_id bigint, commit bigint").parquet(f"{target}/table")
    return seen.groupBy("news_id", "day").agg(F.max("commit").alias("commit"), F.count(F.lit(1)).alias("times"))


@query("""WITH e AS (SELECT ts::DATE AS day, event_type, event_id, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) AS place, ts FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY place) AS n FROM e WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)
    SELECT day, event_type AS feed, n::BIGINT AS rank, 'Event ' || event_id || ' & <more>' AS title, 'http://feed.example/' || event_id AS link, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS published FROM i WHERE n <= 20""")
def feed_items(spark, sf_dir):
    """The first items of each day's feeds that have a title and a link: feeds are files of the day, titles stand in CDATA, some dates are no dates."""
    item = F.concat(
        F.lit("<item><title>"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("<![CDATA[Event "), F.col("event_id").cast("string"), F.lit(" & <more>]]>"))).otherwise(" "),
        F.lit("</title><link> "), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("http://feed.example/"), F.col("event_id").cast("string"))).otherwise(""), F.lit("</link><pubDate>"),
        F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon"), F.lit("</pubDate></item>"),
    )
    own = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", item.alias("item")))).alias("items"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda x: x["item"]), "\n"), F.lit("</channel></rss>"))
    path = _folder(spark, "feeds")
    Y.write_texts(own.select("day", F.concat("event_type", F.lit(".xml")).alias("name"), xml.alias("text")), path)
    feeds = Y.read_texts(spark, path).where(F.col("name").endswith(".xml"))
    items = P.rss_items(feeds.withColumn("feed", F.struct("day", F.regexp_extract("name", r"^(.*)\.xml$", 1).alias("name"))), "feed", "text", most=20)
    rank = F.row_number().over(P.Window.partitionBy("feed").orderBy("place")).cast("bigint")
    return items.select("feed.day", F.col("feed.name").alias("feed"), rank.alias("rank"), "title", "link", "published")


@query("""SELECT 'items' AS sheet, source AS key, count(*)::BIGINT AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source
    UNION ALL SELECT 'languages', lang, count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY lang""")
def report_sheets(spark, sf_dir):
    """The last day's report of two sheets: written, then written again over other items."""
    path, docs = _folder(spark, "report"), table(spark, sf_dir, "documents")

    def sheets(items):
        return {name: items.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")) for name, column in (("items", "source"), ("languages", "lang"))}

    C.write_report(sheets(docs), path, "2024-01-01")
    C.write_report(sheets(docs), path, "2024-01-02")
    C.write_report(sheets(docs.where("doc_id % 2 = 0")), path, "2024-01-02")
    read = [C.read_sheet(spark, path, name, schema="key string, n bigint").select(F.lit(name).alias("sheet"), "key", "n") for name in ("items", "languages")]
    return read[0].unionByName(read[1])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def restored_backup(spark, sf_dir):
    """The newest whole snapshot: one that was begun later isn't it, nor one that retention took."""
    path, orders = _folder(spark, "backup"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    C.backup(orders, path, "20240101")
    C.backup(orders.where("o_orderkey % 3 <> 0"), path, "20240102")
    orders.limit(1).write.parquet(f"{path}/20240103/unfinished/data")  # what a write that died leaves
    C.expire_backups(spark, path, "20240102")
    return C.restored(spark, path)


@query("""SELECT '2024010' || (1 + p) AS stamp, count(*)::BIGINT AS n_rows, TRUE AS has_size FROM (SELECT unnest(range(1, 4)) AS p) JOIN orders ON o_orderkey % 4 >= p WHERE p < 3 GROUP BY p""")
def backup_listing(spark, sf_dir):
    """Whole snapshots with their rows and size, by what retention has left."""
    path, orders = _folder(spark, "backups"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    for p in range(3):
        C.backup(orders.where(F.col("o_orderkey") % 4 >= p), path, f"2024010{1 + p}")
    orders.limit(1).write.parquet(f"{path}/20240104/unfinished/data")
    C.expire_backups(spark, path, "20240102")
    return C.backups(spark, path).select("stamp", "n_rows", (F.col("size_mb") >= 0).alias("has_size"))


@query("""SELECT doc_id AS id, source, CASE WHEN doc_id % 2 = 1 THEN lang END AS industry_category, NULL::DOUBLE AS content_score, doc_id % 2 = 1 AS fresh FROM documents""")
def migrated_items(spark, sf_dir):
    """Files written before columns were added, and files written after, under the schema of now: what wasn't there is null, and nothing is rewritten."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("industry_category"))
    path = _folder(spark, "items")
    own.where("id % 2 = 0").select("id", "source").write.parquet(f"{path}/layout=1")
    evolved(own.where("id % 2 = 1"), NEWS).write.parquet(f"{path}/layout=2")
    items = spark.read.schema(T.StructType([*NEWS.fields, T.StructField("layout", T.IntegerType())])).parquet(path)
    return items.select("id", "source", "industry_category", "content_score", (F.col("layout") == 2).alias("fresh"))
