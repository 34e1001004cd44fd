"""Answers of language models as rows: JSON in a text, with what counts where fields are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fenced_json, once

# The fields of an analysis and of a comparison, and what a missing score counts as.
SCORES = ("importance_score", "market_relevance_score", "uncertainty_score", "expert_explainability_score")
TEXTS = ("translated_title", "summary", "industry_category", "content_type", "sentiment", "market_impact")
COMPARED = ("final_insight", "expert_priority", "ai_reference", "conflict_summary")
NO_SCORE = 0.5


def analysis(text: Column) -> Column:
    """struct of scores, texts and keywords; null where the text holds no JSON object."""
    schema = ", ".join([*(f"{s} double" for s in SCORES), *(f"{t} string" for t in TEXTS), "keywords array<string>", "_bad string"])
    read = F.from_json(fenced_json(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    def filled(a: Column) -> Column:
        parts = [F.coalesce(a[s], F.lit(NO_SCORE)).alias(s) for s in SCORES] + [a[t].alias(t) for t in TEXTS]
        return F.when(a.isNotNull() & a["_bad"].isNull(), F.struct(*parts, F.coalesce(a["keywords"], F.array().cast("array<string>")).alias("keywords")))

    return once(read, filled)


def comparison(text: Column) -> Column:
    """struct of whether opinions conflict and what is said about it; null where the text holds no JSON object."""
    schema = ", ".join(["opinion_conflict boolean", *(f"{t} string" for t in COMPARED), "_bad string"])
    read = F.from_json(fenced_json(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    def filled(a: Column) -> Column:
        parts = [F.coalesce(a["opinion_conflict"], F.lit(False)).alias("opinion_conflict"), *(F.coalesce(a[t], F.lit("")).alias(t) for t in COMPARED)]
        return F.when(a.isNotNull() & a["_bad"].isNull(), F.struct(*parts))

    return once(read, filled)
