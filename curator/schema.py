"""Schemas of the curation tables and their fixed values."""

from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


NEWS = _struct(
    id=L, source=S, original_url=S, original_title=S, original_content=S, translated_title=S, summary=S, importance_score=D, industry_category=S,
    content_type=S, sentiment=S, market_impact=S, keywords=T.ArrayType(S), related_news=T.ArrayType(L), published_at=TS, collected_at=TS, analyzed_at=TS,
    is_bookmarked=B, tags=T.ArrayType(S), expert_review_status=S, market_relevance_score=D, uncertainty_score=D, expert_explainability_score=D,
    topic_vector=T.ArrayType(T.FloatType()), content_score=D, score_breakdown=T.MapType(S, T.IntegerType()), score_explanation=S, card_headline=S,
    edition=S, created_at=TS, updated_at=TS,
)
REVIEWS = _struct(
    id=L, news_id=L, ai_comment=S, expert_comment=S, ai_final_review=S, opinion_conflict=B, expert_opinion_priority=S, ai_opinion_reference=S,
    publish_status=S, admin_note=S, publish_status_updated_at=TS, review_started_at=TS, review_completed_at=TS,
    review_duration_seconds=T.IntegerType(), created_at=TS, updated_at=TS,
)
NOTIFICATIONS = _struct(id=L, news_id=L, notification_type=S, title=S, message=S, is_read=B, created_at=TS)
SETTINGS = _struct(id=L, setting_key=S, setting_value=S, updated_at=TS)
USERS = _struct(id=L, email=S, password_hash=S, name=S, dietary_restrictions=T.ArrayType(S), created_at=TS)
RECIPE = _struct(
    name=S, difficulty=S, time=S, servings=S, ingredients=T.ArrayType(_struct(name=S, amount=S)), steps=T.ArrayType(S), missing_ingredients=T.ArrayType(S)
)

REVIEW_STATES = ("none", "queued_today", "commented", "skipped")
PUBLISH_STATES = ("draft", "approved", "published", "discarded", "rejected")
EDITIONS = ("morning", "afternoon", "evening")


def evolved(df, schema: T.StructType):
    """df with the columns that schema has beyond it (null), as an additive migration leaves them."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns])
