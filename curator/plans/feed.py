"""Feed, archive, headline, KPI, trend and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import NEWS_SQL, REVIEWS_SQL, news, reviews, table
from .registry import query

WITH = f"WITH {NEWS_SQL}, {REVIEWS_SQL}"
AS_OF = "2024-01-31"


def published_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a published review that has a comment; several reviews of an item give several rows."""
    own = reviews(spark, sf_dir).where((F.col("publish_status") == "published") & F.col("expert_comment").isNotNull())
    return news(spark, sf_dir).join(own, F.col("id") == F.col("news_id"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published_base(spark, sf_dir).where(X.has_more_than_spaces(F.col("content")))


_PUBLISHED = "news n JOIN reviews r ON n.id = r.news_id WHERE r.publish_status = 'published' AND r.expert_comment IS NOT NULL AND trim(coalesce(n.content, '')) <> ''"
_FEED = f"SELECT n.id, n.source, n.category, n.title, r.expert_comment AS comment, r.reviewed_at FROM {_PUBLISHED}"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).select("id", "source", "category", "title", F.col("expert_comment").alias("comment"), "reviewed_at")


@query(f"{WITH} {_FEED}")
def feed_published(spark, sf_dir):
    return _feed(spark, sf_dir)


@query(f"{WITH} {_FEED} ORDER BY reviewed_at DESC, id LIMIT 20 OFFSET 20")
def feed_second_page(spark, sf_dir):
    return _feed(spark, sf_dir).orderBy(F.desc("reviewed_at"), "id").offset(20).limit(20)


@query(f"{WITH} SELECT count(*) AS n, ceil(count(*) / 20.0)::BIGINT AS pages FROM {_PUBLISHED}")
def feed_count(spark, sf_dir):
    return published(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 20.0).alias("pages"))


@query(f"{WITH} SELECT DISTINCT reviewed_at::DATE AS day FROM {_PUBLISHED}")
def archive_dates(spark, sf_dir):
    return published(spark, sf_dir).select(F.to_date("reviewed_at").alias("day")).distinct()


@query(f"{WITH} SELECT n.id, n.title, n.importance FROM {_PUBLISHED} AND r.reviewed_at::DATE = DATE '2024-01-10'")
def archive_by_date(spark, sf_dir):
    return published(spark, sf_dir).where(F.to_date("reviewed_at") == F.lit("2024-01-10").cast("date")).select("id", "title", "importance")


@query(f"{WITH} SELECT n.*, r.publish_status, r.expert_comment FROM news n LEFT JOIN reviews r ON n.id = r.news_id WHERE n.id = 42")
def item_by_key(spark, sf_dir):
    own = reviews(spark, sf_dir).select("news_id", "publish_status", "expert_comment")
    return news(spark, sf_dir).where("id = 42").join(own, F.col("id") == F.col("news_id"), "left").drop("news_id")


def top_of_editions(items: DataFrame, most: int = 10) -> DataFrame:
    """The first items of each day's editions by importance, then newest review, then id; those of no edition aren't ranked."""
    ranked = items.withColumn("edition", X.edition(F.col("published_at"))).withColumn("day", F.to_date("published_at")).where("edition <> 'none'")
    order = Window.partitionBy("day", "edition").orderBy(F.desc(X.number_or(F.col("importance"), 0.5)), F.desc("reviewed_at"), "id")
    return ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)


_EDITION = "CASE WHEN hour(published_at) < 7 THEN 'morning' WHEN hour(published_at) < 14 THEN 'afternoon' WHEN hour(published_at) < 22 THEN 'evening' ELSE 'none' END"


@query(f"""{WITH}, base AS (SELECT n.*, r.reviewed_at, {_EDITION} AS edition, published_at::DATE AS day FROM news n JOIN reviews r ON n.id = r.news_id
    WHERE r.publish_status = 'published' AND r.expert_comment IS NOT NULL)
    SELECT day, edition, rank, id, headline FROM (SELECT *, coalesce(CASE WHEN id % 4 = 0 THEN 'Card ' || id END, substr(title, 1, 20)) AS headline, row_number() OVER (PARTITION BY day, edition
        ORDER BY CASE WHEN importance <> 0 THEN importance ELSE 0.5 END DESC, reviewed_at DESC, id) AS rank FROM base WHERE edition <> 'none') WHERE rank <= 10""")
def edition_headlines(spark, sf_dir):
    """The stored headline of an item, which every fourth has here; else its title, cut."""
    top = top_of_editions(published_base(spark, sf_dir))
    stored = F.when(F.col("id") % 4 == 0, F.concat(F.lit("Card "), F.col("id").cast("string")))
    return top.select("day", "edition", "rank", "id", F.coalesce(stored, F.substring("title", 1, 20)).alias("headline"))


@query(f"""{WITH} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'none') AS waiting, count(*) FILTER (WHERE status = 'queued_today') AS queued,
    count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status IS NULL) AS unknown, count(r.news_id) AS reviewed,
    count(*) FILTER (WHERE r.publish_status = 'published') AS published, count(*) FILTER (WHERE r.publish_status = 'discarded') AS discarded,
    count(*) FILTER (WHERE r.opinion_conflict) AS conflicts, count(*) FILTER (WHERE importance >= 0.7) AS important,
    count(*) FILTER (WHERE published_at::DATE = DATE '2024-01-15') AS that_day, round(avg(importance), 6) AS mean_importance,
    round(avg(importance) FILTER (WHERE importance > 0.1), 6) AS mean_scored FROM news n LEFT JOIN reviews r ON n.id = r.news_id""")
def kpi_one_pass(spark, sf_dir):
    """All counters of the dashboard from one scan and one join."""
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"), "left")
    n = lambda where: F.count_if(where)
    return joined.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("status") == "none").alias("waiting"), n(F.col("status") == "queued_today").alias("queued"),
        n(F.col("status") == "skipped").alias("skipped"), n(F.col("status").isNull()).alias("unknown"), F.count("news_id").alias("reviewed"),
        n(F.col("publish_status") == "published").alias("published"), n(F.col("publish_status") == "discarded").alias("discarded"), n(F.col("opinion_conflict")).alias("conflicts"),
        n(F.col("importance") >= 0.7).alias("important"), n(F.to_date("published_at") == F.lit("2024-01-15").cast("date")).alias("that_day"),
        F.round(F.avg("importance"), 6).alias("mean_importance"), F.round(F.avg(F.when(F.col("importance") > 0.1, F.col("importance"))), 6).alias("mean_scored"),
    )


@query(f"""{WITH} SELECT coalesce(r.publish_status, 'other') AS state, count(*) AS n, round(avg(n.importance), 6) AS mean_importance FROM news n LEFT JOIN reviews r ON n.id = r.news_id GROUP BY 1""")
def category_stats(spark, sf_dir):
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"), "left")
    return joined.groupBy(F.coalesce("publish_status", F.lit("other")).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query(f"""{WITH} SELECT r.publish_status AS state, count(*) AS n, round(avg(n.importance), 6) AS mean_importance FROM news n LEFT JOIN reviews r ON n.id = r.news_id
    WHERE r.publish_status IS NOT NULL GROUP BY 1""")
def category_stats_without_null(spark, sf_dir):
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"), "left")
    known = joined.where(F.col("publish_status").isNotNull())
    return known.groupBy(F.col("publish_status").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query(f"{WITH} SELECT source, count(*) AS n FROM news GROUP BY source")
def source_counts(spark, sf_dir):
    return news(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT source, published_at::DATE AS day, count(*) AS n FROM news WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2")
def source_day_trend(spark, sf_dir):
    recent = news(spark, sf_dir).where(F.col("published_at") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval 7 days"))
    return recent.groupBy("source", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, top AS (SELECT source FROM news GROUP BY source ORDER BY count(*) DESC, source LIMIT 8)
    SELECT source, published_at::DATE AS day, count(*) AS n FROM news WHERE source IN (SELECT source FROM top) GROUP BY 1, 2""")
def trend_of_top_sources(spark, sf_dir):
    items = news(spark, sf_dir).select("source", F.to_date("published_at").alias("day"))
    top = items.groupBy("source").count().orderBy(F.desc("count"), "source").limit(8)
    return items.join(top, "source", "left_semi").groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))


def report(items: DataFrame, *, days: int | None = None, sources: list[str] | None = None, least: float | None = None, states: list[str] | None = None, keyword: str | None = None) -> DataFrame:
    """A report whose predicates are those that are given."""
    wanted: list[Column] = []
    if days is not None:
        wanted.append(F.col("published_at") >= F.expr(f"timestamp_ntz'{AS_OF}'") - F.expr(f"interval {int(days)} days"))
    if sources is not None:
        wanted.append(F.col("source").isin(sources))
    if least is not None:
        wanted.append(F.col("importance") >= least)
    if states is not None:
        wanted.append(F.col("publish_status").isin(states))
    if keyword is not None:
        wanted.append(F.col("content").contains(keyword))
    for predicate in wanted:
        items = items.where(predicate)
    return items


@query(f"""{WITH} SELECT n.id, n.source, n.importance, r.publish_status FROM news n LEFT JOIN reviews r ON n.id = r.news_id
    WHERE published_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND source IN ('src0', 'src1', 'src2') AND importance >= 0.05 AND publish_status IN ('published', 'draft')""")
def dynamic_report(spark, sf_dir):
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"), "left")
    return report(joined, days=14, sources=["src0", "src1", "src2"], least=0.05, states=["published", "draft"]).select("id", "source", "importance", "publish_status")


@query(f"""{WITH} SELECT metric, value FROM (SELECT count(*)::DOUBLE AS items, round(avg(importance), 4) AS mean, count(*) FILTER (WHERE importance >= 0.7)::DOUBLE AS important,
    count(r.news_id)::DOUBLE AS reviewed, count(*) FILTER (WHERE r.opinion_conflict)::DOUBLE AS conflicts FROM news n LEFT JOIN reviews r ON n.id = r.news_id)
    UNPIVOT (value FOR metric IN (items, mean, important, reviewed, conflicts))""")
def report_kpi_rows(spark, sf_dir):
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"), "left")
    one = joined.agg(
        F.count(F.lit(1)).cast("double").alias("items"), F.round(F.avg("importance"), 4).alias("mean"), F.count_if(F.col("importance") >= 0.7).cast("double").alias("important"),
        F.count("news_id").cast("double").alias("reviewed"), F.count_if(F.col("opinion_conflict")).cast("double").alias("conflicts"),
    )
    return one.unpivot([], ["items", "mean", "important", "reviewed", "conflicts"], "metric", "value")


@query(f"""{WITH} SELECT id, source, title, published_at FROM news WHERE (status = 'none' OR status IS NULL) AND status <> 'skipped' AND published_at IS NOT NULL
    AND coalesce(content, '') <> '' AND trim(content) <> '' AND source NOT IN ('src3') AND {_EDITION} = 'morning' AND published_at::DATE = DATE '2024-01-12'""")
def eligible_candidates(spark, sf_dir):
    """Three-valued logic leaves out items whose status is null."""
    status = F.col("status")
    fit = ((status == "none") | status.isNull()) & (status != "skipped") & F.col("published_at").isNotNull() & X.has_more_than_spaces(F.col("content")) & ~F.col("source").isin("src3")
    window = (X.edition(F.col("published_at")) == "morning") & (F.to_date("published_at") == F.lit("2024-01-12").cast("date"))
    return news(spark, sf_dir).where(fit & window).select("id", "source", "title", "published_at")


@query(f"""{WITH} SELECT CASE WHEN published_at::DATE = DATE '2024-01-30' THEN 'today' WHEN published_at::DATE = DATE '2024-01-29' THEN 'yesterday' ELSE 'earlier' END AS bucket,
    CASE WHEN importance >= 0.8 THEN 'very high' WHEN importance >= 0.6 THEN 'high' WHEN importance >= 0.4 THEN 'medium' ELSE 'low' END AS badge, count(*) AS n FROM news GROUP BY 1, 2""")
def badges_by_day_bucket(spark, sf_dir):
    bucket, badge = X.day_bucket(F.col("published_at"), "2024-01-30"), X.importance_badge(F.col("importance"))
    return news(spark, sf_dir).groupBy(bucket.alias("bucket"), badge.alias("badge")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT least(floor(importance * 100 / 20), 5)::BIGINT AS bin, count(*) AS n FROM news GROUP BY 1")
def histogram_scores(spark, sf_dir):
    return news(spark, sf_dir).groupBy(F.least(F.floor(F.col("importance") * 100 / 20), F.lit(5)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH} SELECT source, round(avg(importance), 6) AS mean, round(median(importance), 6) AS med, round(stddev_samp(importance), 6) AS sd, min(importance) AS lo, max(importance) AS hi FROM news GROUP BY source""")
def summary_stats(spark, sf_dir):
    x = F.col("importance")
    return news(spark, sf_dir).groupBy("source").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("med"), F.round(F.stddev_samp(x), 6).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )


@query(f"""{WITH} SELECT source, id, rank FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY importance DESC, id) AS rank FROM news) WHERE rank <= 20""")
def first_of_each_source(spark, sf_dir):
    order = Window.partitionBy("source").orderBy(F.desc("importance"), "id")
    return news(spark, sf_dir).select("source", "id", F.row_number().over(order).cast("bigint").alias("rank")).where("rank <= 20")


@query("""SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy(parsed.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT DISTINCT tag FROM (SELECT unnest([event_type, 'k' || (json_extract(props, '$.k')::BIGINT % 10)]) AS tag FROM events)""")
def distinct_tags(spark, sf_dir):
    """Distinct values of exploded arrays, from JSON and plain columns."""
    tags = F.array(F.col("event_type"), F.concat(F.lit("k"), (F.from_json("props", "k bigint")["k"] % 10).cast("string")))
    return table(spark, sf_dir, "events").select(F.explode(tags).alias("tag")).distinct()


@query("""SELECT event_id, user_id FROM events WHERE list_contains([event_type, 'k' || (json_extract(props, '$.k')::BIGINT % 10)], 'k3')""")
def items_with_tag(spark, sf_dir):
    tags = F.array(F.col("event_type"), F.concat(F.lit("k"), (F.from_json("props", "k bigint")["k"] % 10).cast("string")))
    return table(spark, sf_dir, "events").where(F.array_contains(tags, "k3")).select("event_id", "user_id")


@query("""SELECT e.event_id, e.event_type, c.c_name FROM events e LEFT JOIN customer c ON CASE WHEN e.event_id % 4 > 0 THEN e.user_id END = c.c_custkey""")
def notifications_with_items(spark, sf_dir):
    """Left join on a nullable key."""
    own = table(spark, sf_dir, "events").withColumn("key", F.when(F.col("event_id") % 4 > 0, F.col("user_id")))
    return own.join(table(spark, sf_dir, "customer"), F.col("key") == F.col("c_custkey"), "left").select("event_id", "event_type", "c_name")


@query("""SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey <> 3
    LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_with_default(spark, sf_dir):
    """Dimension lookups whose misses have a default; Spark broadcasts the dimensions by their size."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey <> 3")
    joined = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("""SELECT conv_id, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id""")
def rows_grouped_to_lists(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("all"), F.count(F.lit(1)).alias("n"))
    return own.select("conv_id", F.col("all.text").alias("texts"), "n")


@query("""SELECT role, count(*) AS total, count(*) FILTER (WHERE length(text) > 200) AS done, CASE WHEN count(*) = 0 THEN 0 ELSE floor(100.0 * count(*) FILTER (WHERE length(text) > 200) / count(*)) END::BIGINT AS percent
    FROM conversations GROUP BY role""")
def progress_ratio(spark, sf_dir):
    done = F.count_if(F.length("text") > 200)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("total"), done.alias("done"), F.floor(100.0 * done / F.count(F.lit(1))).cast("bigint").alias("percent"))


@query("""SELECT lang, round(avg(CASE WHEN (n_chars > 2000)::INT = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def prediction_accuracy(spark, sf_dir):
    hit = F.when((F.col("n_chars") > 2000).cast("int") == F.col("quality"), 1.0).otherwise(0.0)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_first FROM (SELECT doc_id FROM documents WHERE n_chars > 1500) a
    FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def symmetric_difference(spark, sf_dir):
    a = table(spark, sf_dir, "documents").where("n_chars > 1500").select(F.col("doc_id").alias("a"))
    b = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("doc_id"), F.col("a").isNotNull().alias("in_first"))


@query(f"""{WITH} SELECT category, count(*) AS n FROM (SELECT category FROM news WHERE status = 'skipped' UNION ALL SELECT category FROM news n JOIN reviews r ON n.id = r.news_id
    WHERE publish_status IN ('discarded', 'rejected') UNION ALL SELECT category FROM news n JOIN reviews r ON n.id = r.news_id WHERE publish_status IN ('published', 'draft')) GROUP BY 1""")
def processed_titles(spark, sf_dir):
    """The union of three kinds of processed items; approved ones aren't among them."""
    joined = news(spark, sf_dir).join(reviews(spark, sf_dir), F.col("id") == F.col("news_id"))
    parts = [news(spark, sf_dir).where("status = 'skipped'"), joined.where(F.col("publish_status").isin("discarded", "rejected")), joined.where(F.col("publish_status").isin("published", "draft"))]
    every = parts[0].select("category").unionByName(parts[1].select("category")).unionByName(parts[2].select("category"))
    return every.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
