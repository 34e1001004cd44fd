"""Checks of titles and comments together, where rules hit, and fixes of published comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import bound
from ..operators import hits as H
from ..operators import safety as Y
from ..sources.tables import NEWS_SQL, REVIEWS_SQL, news, reviews, spread, table
from .curation import RULES
from .registry import query

_ALL_HITS = " UNION ALL ".join(
    f"""SELECT id, '{r.name}' AS rule, '{r.severity}' AS severity, regexp_extract_all(content, '(?i){r.pattern}') AS h, regexp_split_to_array(content, '(?i){r.pattern}') AS b, content FROM news
    WHERE regexp_matches(content, '(?i){r.pattern}')""" for r in RULES
)


@query(f"""WITH {NEWS_SQL}, a AS ({_ALL_HITS}), p AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM a),
    o AS (SELECT id, rule, severity, h[i] AS found, content, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS pos FROM p)
    SELECT id, rule, severity, pos::BIGINT AS offset, length(found)::BIGINT AS length, found, substr(content, greatest(pos - 30, 0)::BIGINT + 1, (pos - greatest(pos - 30, 0) + length(found) + 30)::BIGINT) AS context FROM o""")
def safety_offsets(spark, sf_dir):
    """Every hit of every rule with its place and what stands around it, by a table function in SQL."""
    name = H.registered(spark, "text_hits", RULES)
    items = spread(news(spark, sf_dir).select("id", "content"))
    return spark.sql(f"SELECT id, rule, severity, offset, length, found, context FROM {name}(TABLE(SELECT id, content AS text FROM {{items}}))", items=items)


#: Rules of style that comments of published reviews meet, of which one blocks.
STYLE = [Y.Rule("stop", "critical", r"ththe\w+ th"), Y.Rule("gap", "high", r"hathe|onthe", "[the]"), Y.Rule("end", "medium", r"tion[.]", "tion!"), Y.Rule("ing", "low", r"ing\b")]
#: Comments of reviews: what stands behind the title in the item's text; every thirteenth review has none.
_COMMENTED_SQL = f"""{NEWS_SQL}, {REVIEWS_SQL}, c AS (SELECT n.id, n.title, r.publish_status, CASE WHEN r.expert_comment IS NOT NULL THEN substr(n.content, 61) END AS comment, r.news_id IS NOT NULL AS reviewed
    FROM news n LEFT JOIN reviews r ON r.news_id = n.id), t AS (SELECT *, coalesce(title, '') || chr(10) || coalesce(comment, '') AS t FROM c)"""
_COUNTS = ", ".join(f"({' + '.join(f'len(regexp_extract_all(t, $${f'(?i){r.pattern}'}$$))' for r in RULES if r.severity == s)})::BIGINT AS {s}" for s in Y.SEVERITIES)


def _commented(spark, sf_dir, rules):
    items = news(spark, sf_dir).select("id", "title", "content")
    own = reviews(spark, sf_dir).select(F.col("news_id").alias("id"), "publish_status", F.col("expert_comment").isNotNull().alias("_said"))
    joined = items.join(own, "id", "left").withColumn("comment", F.when(F.col("_said"), F.expr("substr(content, 61)"))).drop("content", "_said")
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("comment", F.lit("")))
    return bound(joined, "f", Y.findings(whole, rules))


@query(f"""WITH {_COMMENTED_SQL}, k AS (SELECT id, {_COUNTS} FROM t) SELECT *, critical > 0 AS blocked, critical + high = 0 AS publishable FROM k""")
def checked_items(spark, sf_dir):
    """Title and review comment of every item as one text; items without a review by their title alone."""
    own = _commented(spark, sf_dir, RULES)
    return own.select("id", *[Y.count_of(F.col("f"), s).cast("bigint").alias(s) for s in Y.SEVERITIES], Y.blocked(F.col("f")).alias("blocked"), Y.publishable(F.col("f")).alias("publishable"))


_STEPS = " || ".join(f"list_transform(regexp_extract_all(t, $$(?i)(?:{r.pattern})$$), lambda x: {{'old': x, 'new': '{r.fix}'}})" for r in STYLE if r.fix)
_CRITICAL = " OR ".join(f"regexp_matches(t, $$(?i){r.pattern}$$)" for r in STYLE if r.severity == "critical")


@query(f"""WITH {_COMMENTED_SQL}, s AS (SELECT id, comment, list_prepend({{'old': comment, 'new': ''}}, {_STEPS}) AS steps FROM t WHERE publish_status = 'published' AND comment IS NOT NULL AND NOT ({_CRITICAL})),
    d AS (SELECT id, comment, list_reduce(steps, lambda a, x: {{'old': replace(a.old, x.old, x.new), 'new': ''}}).old AS fixed FROM s) SELECT id, fixed AS comment FROM d WHERE fixed <> comment""")
def fixed_comments(spark, sf_dir):
    """Comments of published reviews that a fix changes, by what was found in title and comment; those that are blocked stay."""
    own = _commented(spark, sf_dir, STYLE).where((F.col("publish_status") == "published") & F.col("comment").isNotNull() & ~Y.blocked(F.col("f")))
    return own.select("id", "comment", Y.fixed(F.col("comment"), F.col("f"), STYLE).alias("fixed")).where("fixed <> comment").select("id", F.col("fixed").alias("comment"))
