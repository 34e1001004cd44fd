"""Content scoring of items: eight criteria, weights, boosters and what explains them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as K
from ..functions.text import has_text
from ..sources.scratch import dropped, written
from ..sources.tables import spread
from .dedup import greedy_kept, title_keywords, without_processed


def criteria(text: Column, lex) -> dict[str, Column]:
    """The eight criteria of a text under a lexicon (an object with the tables that plans.lexicons has)."""
    return {
        "policy": K.tier(text, lex.POLICY),
        "corporate": K.corporate(text, lex.CORPORATE),
        "industry": K.industry(text, lex.FOOD, lex.INDUSTRY),
        "scale": K.economic_scale(text, lex.MONEY, lex.SCOPE),
        "geography": K.tier(text, lex.GEOGRAPHY),
        "time": K.tier(text, lex.TIME),
        "international": K.tier(text, lex.INTERNATIONAL),
        "social": K.tier(text, lex.SOCIAL),
    }


#: The text of an item while it is scored.
TEXT = "_score_text"


def with_text(items: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """items with title and content joined without a separator."""
    return K.bound(spread(items), TEXT, F.concat(F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))))


def _scored(items: DataFrame, lex) -> DataFrame:
    with_criteria = items.withColumns(criteria(F.col(TEXT), lex))
    names = {name: F.col(name) for name in K.WEIGHTS}
    extra = [("state", 1.2, (F.col("corporate") >= 85) & (F.col("industry") >= 80))]
    return (
        with_criteria.withColumns({"weighted_raw": K.weighted(names), "boosters": K.boosters(F.col(TEXT), lex.BOOSTERS, extra)})
        .withColumn("content_score", K.boosted(F.col("weighted_raw"), F.col("boosters")))
        .withColumn("explanation", K.explanation(names, F.col("boosters"), F.col("content_score")))
    )


def scored(items: DataFrame, lex, title: str = "title", content: str = "content") -> DataFrame:
    """items with one column for each criterion, weighted_raw, boosters, content_score and explanation. The text is title and content joined without a separator."""
    return _scored(with_text(items, title, content), lex).drop(TEXT)


def gate(lex, title: str = "title", content: str = "content", source: str = "source") -> Column:
    """Items with_text that have a content and are factual, analytical and not brief."""
    t, c, text, spared = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit("")), F.col(TEXT), K.exempt(F.col(source), lex.EXEMPT)
    return has_text(c) & K.factual(text, lex.OPINION, lex.ADMINISTRATIVE, spared) & K.analytical(t, text, lex.NOTICE, lex.AMOUNTS, lex.CONCRETE, spared) & ~K.brief(t, c, lex.BRIEF)


@dataclass(frozen=True)
class Dedup:
    """How titles are told apart: core terms and stop words, the processed items (seq, keywords), and the batches in which each title is compared with those published after it."""

    core: list[str]
    stops: list[str]
    processed: DataFrame | None = None
    by: tuple[str, ...] = ()


def unlike_titles(items: DataFrame, dedup: Dedup, title: str = "title") -> DataFrame:
    """The ids of items (id, published_at) without those whose title is like a processed one's, and of each batch only those that a scan, newest first, keeps."""
    keyed = items.select("id", *dedup.by, F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("age"), "id").alias("_place"), title_keywords(F.col(title), dedup.core, dedup.stops).alias("keywords"))
    keyed = written(keyed)  # read often, and the gate before it is costly
    if dedup.processed is not None:
        fresh = written(without_processed(keyed, dedup.processed, dedup.core))
        dropped(keyed)
        keyed = fresh
    return greedy_kept(keyed, dedup.core, "_place", by=dedup.by).select(F.col("_place.id").alias("id")).distinct()


def filtered(items: DataFrame, lex, priorities: DataFrame | None = None, title: str = "title", content: str = "content", dedup: Dedup | None = None) -> DataFrame:
    """Items with a content that are factual, analytical, not brief and, with dedup, no title's repeat, with what selection needs: category, flags, scores and priority.

    priorities: (source, source_priority); sources without one get 5.
    """
    kept = with_text(items, title, content).where(gate(lex, title, content))
    text = F.col(TEXT)
    scope = K.scope(text, lex.BROAD, lex.DEEP)
    out = _scored(kept, lex).withColumns(
        {
            "topic": K.category(text, lex.CATEGORIES), "is_domestic": K.domestic(text, lex.HOME, lex.ABROAD), "fact_richness": K.fact_richness(text, F.coalesce(F.col(content), F.lit("")), lex.FACT_PATTERNS, lex.FACTS),
            "scope_score": scope["score"], "is_broad": scope["broad"],
        }
    )
    if priorities is not None:
        out = out.join(priorities, "source", "left").withColumn("source_priority", F.coalesce("source_priority", F.lit(5)))
    else:
        out = out.withColumn("source_priority", F.lit(5))
    out = out.withColumn("is_central", F.col("source_priority") >= 8)
    out = out.withColumn("formal_normalized", K.formal(F.col("source_priority"), F.col("is_central"), F.col("is_domestic"), F.col("fact_richness")))
    out = out.withColumn("priority_score", K.priority(F.col("formal_normalized"), F.col("content_score"))).drop(TEXT)
    if dedup is not None:  # after the scores, so that texts needn't be shuffled; a semi join would be pushed down to the texts
        out = out.join(unlike_titles(kept, dedup, title), "id")
    return out
