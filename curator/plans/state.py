"""Snapshots, guards, expiry, links, vectors and small collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.links import WEB_LINK_SQL
from ..operators import state as S
from ..operators import vectors as V
from ..sources import pages as P
from ..sources.tables import NEWS_SQL, REVIEWS_SQL, news, reviews, table
from .registry import query

WITH = f"WITH {NEWS_SQL}, {REVIEWS_SQL}"
AS_OF = "2024-01-31 00:00:00"


@query("""WITH old AS (SELECT text, doc_id FROM documents WHERE doc_id < 500), fresh AS (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE doc_id >= 500)
    SELECT doc_id FROM fresh WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.text = fresh.text)""")
def insert_or_ignore(spark, sf_dir):
    """A later batch appended to an earlier one on a unique key."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.insert_or_ignore(own.where("doc_id < 500"), own.where("doc_id >= 500"), "text", [F.col("doc_id")]).select("doc_id")


@query("""SELECT setting_key, setting_value FROM (SELECT user_id AS setting_key, event_type || ':' || value AS setting_value, row_number() OVER (PARTITION BY user_id
    ORDER BY (ts >= TIMESTAMP '2024-01-15') DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_settings(spark, sf_dir):
    """The events of the month's second half put over those of the first, newest by user."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("setting_key"), F.concat("event_type", F.lit(":"), F.col("value").cast("string")).alias("setting_value"), "ts", "event_id")
    cut = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    newest = [F.desc("ts"), F.desc("event_id")]
    return S.upsert(S.latest(own.where(F.col("ts") < cut), "setting_key", newest), own.where(F.col("ts") >= cut), "setting_key", newest).select("setting_key", "setting_value")


@query("SELECT coalesce((SELECT event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1), 'none') AS event_type")
def setting_with_default(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumns({"order": F.struct("ts", "event_id"), "name": F.col("user_id").cast("string")})
    return S.setting(own, "7", "none", "name", "event_type", "order")


@query(f"{WITH} SELECT id, CASE WHEN status = 'queued_today' AND published_at < TIMESTAMP '2024-01-20' THEN 'none' ELSE status END AS status FROM news")
def stale_reset(spark, sf_dir):
    stale = (F.col("status") == "queued_today") & (F.col("published_at") < F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return S.where_set(news(spark, sf_dir), F.coalesce(stale, F.lit(False)), {"status": F.lit("none")}).select("id", "status")


@query(f"{WITH} SELECT status, count(*) FILTER (WHERE status = 'skipped') AS changed, count(*) AS n FROM news GROUP BY status")
def compare_and_set_count(spark, sf_dir):
    """How many rows a restore of skipped items would change."""
    return news(spark, sf_dir).groupBy("status").agg(F.count_if(F.col("status") == "skipped").alias("changed"), F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT id, CASE WHEN r.publish_status IN ('published', 'discarded') THEN r.publish_status ELSE n.status END AS status FROM news n LEFT JOIN reviews r ON n.id = r.news_id")
def bulk_update(spark, sf_dir):
    """A set-based update: copy on write by a join of the changes."""
    changes = reviews(spark, sf_dir).where(F.col("publish_status").isin("published", "discarded")).select(F.col("news_id").alias("id"), F.col("publish_status").alias("status"))
    return S.patched(news(spark, sf_dir).select("id", "status"), changes, "id", ["status"])


@query(f"""{WITH} SELECT news_id, EXISTS (SELECT 1 FROM news n WHERE n.id = r.news_id AND n.status = 'queued_today') AS accepted FROM reviews r""")
def trigger_guard(spark, sf_dir):
    """Reviews of items that aren't queued are rejected."""
    accepted, rejected = S.guarded(reviews(spark, sf_dir), news(spark, sf_dir), "news_id", "id", F.col("status") == "queued_today")
    return accepted.select("news_id", F.lit(True).alias("accepted")).unionByName(rejected.select("news_id", F.lit(False).alias("accepted")))


@query(f"{WITH} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM reviews r WHERE r.news_id = n.id) AND status = 'queued_today' THEN 'commented' ELSE status END AS status FROM news n")
def status_after_review(spark, sf_dir):
    changes = reviews(spark, sf_dir).join(news(spark, sf_dir).where("status = 'queued_today'"), F.col("news_id") == F.col("id"), "left_semi")
    return S.patched(news(spark, sf_dir).select("id", "status"), changes.select(F.col("news_id").alias("id"), F.lit("commented").alias("status")).distinct(), "id", ["status"])


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def age_out(spark, sf_dir):
    return S.retained(table(spark, sf_dir, "events"), "ts", AS_OF, 10).select("event_id")


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_acctbal < 0)")
def delete_by_key(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(gone, "user_id", "left_anti").select("event_id", "user_id")


@query("""SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY conv_id, turn) AS event_id, conv_id, turn FROM conversations""")
def insert_with_new_keys(spark, sf_dir):
    incoming = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return S.numbered_after(table(spark, sf_dir, "events"), incoming, "event_id", [F.col("conv_id"), F.col("turn")]).select("event_id", "conv_id", "turn")


@query("""SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS orphans, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def foreign_key_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    orphans = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return orphans.crossJoin(orders.agg(F.count(F.lit(1)).alias("n")))  # one row each


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 50""")
def threshold_alerts(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("value") >= 50)).select("event_id", "user_id", "value")


_LINK = """SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']?([^"''>\\s]*)["'']?[^>]*>(.*?)</a>', 1)) AS href,
    trim(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']?([^"''>\\s]*)["'']?[^>]*>(.*?)</a>', 2)), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']?([^"''>\\s]*)["'']?[^>]*>(.*?)</a>', 1), 1) - 1 AS place FROM pages"""


@query(f"""WITH a AS (SELECT *, url AS base FROM ({_LINK})), b AS (SELECT page_id, place, title, {WEB_LINK_SQL} AS link FROM a WHERE href <> '' AND length(title) >= 3),
    c AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY place) AS n FROM b WHERE regexp_matches(link, 'example')), d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rank FROM c WHERE n = 1)
    SELECT page_id, rank, link, title FROM d WHERE rank <= 20""")
def page_links(spark, sf_dir):
    return P.links(table(spark, sf_dir, "pages"), 3, "example", 20)


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages""")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.page_title(F.col("html")).alias("title"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query("""SELECT event_id, try_cast(strftime(ts, '%Y-%m-%d') AS DATE) AS day FROM events""")
def dates_in_urls(spark, sf_dir):
    """Dates are found in URLs made from the events' times, in four forms by turns."""
    forms = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "'/'yyyy-MM'/'dd'/a'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "'/'yyyyMMdd'/a'")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "'/'yyyy'/'MM'/'dd'/a'")).otherwise(F.date_format("ts", "'/'yyyy'/'MMdd'/a'"))
    url = F.concat(F.lit("http://a.example"), forms)
    return table(spark, sf_dir, "events").select("event_id", X.date_in_url(url).alias("day"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-02-01' - to_minutes((event_id % 60)::INT) WHEN 1 THEN TIMESTAMP '2024-02-01' - to_hours((event_id % 24)::INT)
    WHEN 2 THEN TIMESTAMP '2024-02-01' - to_days((event_id % 30)::INT) ELSE date_trunc('minute', ts) END AS at_time FROM events""")
def relative_times(spark, sf_dir):
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.concat((e % 60).cast("string"), F.lit(" minutes ago"))).when(e % 4 == 1, F.concat((e % 24).cast("string"), F.lit(" hours ago"))).when(e % 4 == 2, F.concat((e % 30).cast("string"), F.lit(" days ago"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return table(spark, sf_dir, "events").select("event_id", X.relative_time(said, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("at_time"))


_VECTOR_TEXT = "lower(trim(substr(text, 1, 60) || ' ' || text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"


@query(f"""WITH t AS (SELECT doc_id, {_VECTOR_TEXT} AS t FROM documents), p AS (SELECT doc_id, substr(t, (1000 * j + 1)::INT, 1003) AS t FROM (SELECT doc_id, t, unnest(range(length(t) // 1000 + 1)) AS j FROM t)),
    g AS (SELECT doc_id, substr(t, i::INT, n::INT) AS gram FROM p, range(2, 5) r(n), range(1, 1001) s(i) WHERE i <= length(t) - n + 1),
    h AS (SELECT doc_id, count(*) AS c, md5(gram) AS m FROM g GROUP BY doc_id, gram), v AS (SELECT doc_id, c, (((((('0x' || substr(m, 1, 8))::BIGINT % 768 * 256 + ('0x' || substr(m, 9, 8))::BIGINT % 768) % 768) * 256
        + ('0x' || substr(m, 17, 8))::BIGINT % 768) % 768) * 256 + ('0x' || substr(m, 25, 8))::BIGINT % 768) % 768 AS r FROM h),
    s AS (SELECT doc_id, r % 384 AS idx, sum(CASE WHEN r < 384 THEN c ELSE -c END) AS v FROM v GROUP BY 1, 2 HAVING sum(CASE WHEN r < 384 THEN c ELSE -c END) <> 0)
    SELECT doc_id, idx::INT AS idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s""")
def hash_vectors(spark, sf_dir):
    """Title and whole text of each document; the SQL cuts texts in pieces of 1,000 characters that overlap by three."""
    text = F.concat(F.substring("text", 1, 60), F.lit(" "), F.col("text"))
    return V.hashed_ngrams(table(spark, sf_dir, "documents"), "doc_id", text, most=None).select("doc_id", "idx", F.round("value", 6).alias("value"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query, vec_id AS item, list_cosine_similarity(qe, embedding::DOUBLE[]) AS c FROM q, embeddings WHERE vec_id <> query)
    SELECT query, item, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS rank FROM p) WHERE rank <= 10""")
def cosine_top_k(spark, sf_dir):
    """An extension: the ten nearest vectors of a stated set of queries."""
    own = table(spark, sf_dir, "embeddings")
    return V.cosine_top_k(own.where("vec_id % 20 = 0"), own, 10).select("query", "item", F.round("cosine", 6).alias("cosine"), "rank")


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS asked, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id""")
def list_counts(spark, sf_dir):
    """Counts of a list, and its first entry."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("asked"), F.min_by("text", "turn").alias("first_text"))


@query("""SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant'), turn) AS place FROM conversations WHERE length(text) > 20) WHERE place <= 5""")
def open_items_first(spark, sf_dir):
    """A filter and a stable sort of finished entries behind open ones."""
    order = Window.partitionBy("conv_id").orderBy(F.col("role") == "assistant", "turn")
    return table(spark, sf_dir, "conversations").where(F.length("text") > 20).select("conv_id", "turn", F.row_number().over(order).cast("bigint").alias("place")).where("place <= 5")


@query("""SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 60) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id""")
def card_previews(spark, sf_dir):
    """The first two turns of each conversation: only these are gathered."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    first = table(spark, sf_dir, "conversations").withColumn("place", place).where("place <= 2")
    steps = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return first.groupBy("conv_id").agg(steps.alias("s")).select("conv_id", F.substring(F.array_join(F.col("s.text"), " "), 1, 60).alias("preview"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type) || ['view'])) AS kinds FROM events GROUP BY user_id""")
def append_if_absent(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return own.select("user_id", F.sort_array(F.array_union("kinds", F.array(F.lit("view")))).alias("kinds"))


@query("""SELECT page_id, list_contains(['html', 'htm'], lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1))) AS allowed FROM pages""")
def extension_whitelist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.extension_allowed(F.col("url"), ["html", "htm"]).alias("allowed"))
