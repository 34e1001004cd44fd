"""Streams run to the end of what is there, JSON answers, and the extensions that the survey lists apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import incremental as I
from ..streaming import timers as T
from .more import MOVES
from .registry import query

_EDITION = "CASE WHEN hour(ts) < 7 THEN 'morning' WHEN hour(ts) < 14 THEN 'afternoon' WHEN hour(ts) < 22 THEN 'evening' ELSE 'none' END"


@query(f"SELECT ts::DATE AS day, {_EDITION} AS edition, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def edition_counts_stream(spark, sf_dir):
    target, checkpoint = I.folders(spark)
    I.run_edition_counts(I.arrivals(spark, sf_dir, "events"), target, checkpoint)
    return I.rolled_up(spark, target).select("day", "edition", "n", F.round("total", 4).alias("total"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def incremental_ingest(spark, sf_dir):
    target, checkpoint = I.folders(spark)
    arriving = I.arrivals(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    I.run_ingest(arriving, target, checkpoint, "digest", "doc_id", bits=5)
    return spark.read.parquet(target).select("doc_id")


_HOURS = 20
_MOVED = " ".join(f"WHEN q = '{a}' AND e = '{b}' THEN '{c}'" for (a, b), c in MOVES.items())


@query(f"""WITH RECURSIVE w AS (SELECT epoch_ms(max(ts)) - 172800000 AS w FROM events),
    e AS (SELECT user_id, epoch_ms(ts) AS t, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events, w WHERE epoch_ms(ts) <= w),
    m(user_id, n, s, since) AS (SELECT DISTINCT user_id, 0::BIGINT, 'none', 0::BIGINT FROM e UNION ALL
        SELECT user_id, n, after, CASE WHEN after <> q THEN t ELSE since END FROM (SELECT *, CASE {_MOVED} ELSE q END AS after
            FROM (SELECT e.user_id, e.n, e.t, e.e, m.since, CASE WHEN m.s = 'queued_today' AND m.since + {_HOURS * 3600000} <= e.t THEN 'none' ELSE m.s END AS q FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1) x))
    SELECT user_id, CASE WHEN s = 'queued_today' AND since + {_HOURS * 3600000} <= w THEN 'none' ELSE s END AS state FROM m, w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def states_with_expiry_stream(spark, sf_dir):
    """Where each user's events lead as of the stream's watermark; a queued state ends by itself after some hours."""
    target, checkpoint = I.folders(spark)
    T.run_machine(I.arrivals(spark, sf_dir, "events"), target, checkpoint, "user_id", "event_type", "ts", "event_id", "none", MOVES, {"queued_today": (_HOURS * 3600000, "none")})
    return T.last_states(spark, target).select(F.col("key").alias("user_id"), "state")


# ---------------------------------------------------------------- extensions
@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ROLLUP (n_name, o_orderpriority)""")
def extension_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT event_id, user_id, round(date_diff('second', lag(ts) OVER w, ts), 0)::BIGINT AS gap, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def extension_lag_and_moving_average(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.lag("ts").over(w)).cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", gap.alias("gap"), F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("moving"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM n GROUP BY 1, 2""")
def extension_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    numbered = table(spark, sf_dir, "events").withColumn("starts", starts).withColumn("session", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("""SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def extension_as_of_join(spark, sf_dir):
    """The last order of each event's user before it: both sides in one sorted stream, the last order carried forward."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    left = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("bigint").alias("o_orderkey"))
    right = orders.select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"), F.lit(None).cast("bigint").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("who").orderBy("at", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("last", F.last("o_orderkey", ignorenulls=True).over(w))
    return both.where("event_id IS NOT NULL").select("event_id", F.col("last").alias("o_orderkey"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def extension_pricing_summary(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02 00:00:00'"))
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
