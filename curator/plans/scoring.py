"""Lexicon scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as K
from ..operators.score import TEXT, criteria, filtered, gate, scored, with_text
from ..operators.terms import term_counts, terms_found
from ..sources.tables import NEWS_SQL, news, table
from . import lexicons as lex
from .registry import query


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, {_lit(w)})" for w in words) + ")"


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(t, {_lit(w)})::INT" for w in words) + ")"


def _tier(tiers) -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN {_any(w)} THEN {s} ELSE 0 END" for s, w in tiers) + ")"


def _corporate() -> str:
    """The cascade as the lexicon's users know it: each step only raises the score."""
    c = lex.CORPORATE
    a = f"CASE WHEN {_any(c.state_owned)} THEN CASE WHEN {_any(c.strategic)} THEN 100 ELSE 85 END ELSE 0 END"
    for words, score in ((c.private, 80), (c.foreign, 60), (c.local, 60)):
        a = f"CASE WHEN {_any(words)} AND ({a}) < {score} THEN {score} ELSE ({a}) END"
    return f"CASE WHEN {_any(c.generic)} AND ({a}) = 0 THEN 40 ELSE ({a}) END"


def _most(unit: str, factor: float) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*{unit}', 1), lambda x: x::DOUBLE * {factor})), 0)"


def _amount() -> str:
    """In three steps: the largest unit, the word if that gives nothing, the smaller unit if what there is isn't enough."""
    m = lex.MONEY
    large = _most(*m.largest)
    first = f"(CASE WHEN {large} > 0 THEN {large} WHEN contains(t, {_lit(m.word[0])}) THEN {m.word[1]} ELSE 0 END)"
    return f"(CASE WHEN {first} >= {m.enough} OR {_most(*m.smaller)} <= {first} THEN {first} ELSE {_most(*m.smaller)} END)::DOUBLE"


_SCALE = f"least(100, CASE WHEN amount >= 1e11 THEN 100 WHEN amount >= 1e10 THEN 80 WHEN amount >= 1e9 THEN 60 WHEN amount >= 1e8 THEN 40 ELSE 20 END + {_tier(lex.SCOPE)})"
_CRITERIA = {
    "policy": _tier(lex.POLICY), "corporate": _corporate(), "industry": f"greatest(CASE WHEN {_any(lex.FOOD)} THEN 80 ELSE 0 END, {_tier(lex.INDUSTRY)})", "scale": _SCALE,
    "geography": _tier(lex.GEOGRAPHY), "time": _tier(lex.TIME), "international": _tier(lex.INTERNATIONAL), "social": _tier(lex.SOCIAL),
}
_BASE = f"WITH {NEWS_SQL}, texts AS (SELECT *, coalesce(title, '') || coalesce(content, '') AS t FROM news), amounts AS (SELECT *, {_amount()} AS amount FROM texts)"
SCORES = f"{_BASE}, scores AS (SELECT *, {', '.join(f'{sql} AS s_{name}' for name, sql in _CRITERIA.items())} FROM amounts)"
RAW = " + ".join(f"s_{name} * {weight}::DOUBLE" for name, weight in K.WEIGHTS.items())
FACTOR = " * ".join(
    [*(f"CASE WHEN {_any(words)} THEN {factor}::DOUBLE ELSE 1.0 END" for _, factor, words in lex.BOOSTERS), "CASE WHEN s_corporate >= 85 AND s_industry >= 80 THEN 1.2::DOUBLE ELSE 1.0 END"]
)


@query(f"{SCORES} SELECT id, {', '.join(f's_{n}::BIGINT AS {n}' for n in _CRITERIA)} FROM scores")
def score_criteria(spark, sf_dir):
    return with_text(news(spark, sf_dir)).select("id", *[c.cast("bigint").alias(n) for n, c in criteria(F.col(TEXT), lex).items()])


@query(f"{SCORES} SELECT id, round(least(({RAW}) * least({FACTOR}, 1.3::DOUBLE), 100.0), 4) AS total FROM scores")
def score_total(spark, sf_dir):
    return scored(news(spark, sf_dir), lex).select("id", F.round(F.least(F.col("weighted_raw") * F.least(F.aggregate("boosters", F.lit(1.0), lambda a, x: a * x["factor"]), F.lit(1.3)), F.lit(100.0)), 4).alias("total"))


@query(f"{_BASE} SELECT id, amount FROM amounts")
def score_amount(spark, sf_dir):
    return with_text(news(spark, sf_dir)).select("id", K.amount_of(F.col(TEXT), lex.MONEY).alias("amount"))


@query(f"""{_BASE}, c AS (SELECT id, {', '.join(f'{_hits(w)} AS c{i}' for i, w in enumerate(lex.CATEGORIES.values()))} FROM texts)
    SELECT id, CASE {' '.join(f"WHEN c{i} = greatest({', '.join(f'c{j}' for j in range(len(lex.CATEGORIES)))}) THEN {_lit(n)}" for i, n in enumerate(lex.CATEGORIES))} END AS topic FROM c""")
def categorize(spark, sf_dir):
    return with_text(news(spark, sf_dir)).select("id", K.category(F.col(TEXT), lex.CATEGORIES).alias("topic"))


FACTS = f"""least(12, 3 * ({' + '.join(f"regexp_matches(t, {_lit(p)})::INT" for p in lex.FACT_PATTERNS)})) + least(8, 2 * {_hits(lex.FACTS)})
    + CASE WHEN length(coalesce(content, '')) > 500 THEN 3 WHEN length(coalesce(content, '')) > 250 THEN 1 WHEN length(coalesce(content, '')) < 50 THEN -15 WHEN length(coalesce(content, '')) < 100 THEN -5 ELSE 0 END"""
DOMESTIC = f"({_hits(lex.HOME)} > {_hits(lex.ABROAD)} OR {_hits(lex.ABROAD)} <= 1)"
SCOPE_SCORE = f"CASE WHEN {_hits(lex.BROAD)} > {_hits(lex.DEEP)} THEN 10 + {_hits(lex.BROAD)} WHEN {_hits(lex.DEEP)} > {_hits(lex.BROAD)} THEN 5 - {_hits(lex.DEEP)} ELSE 7 END"


@query(f"""{_BASE} SELECT id, ({FACTS})::BIGINT AS facts, {DOMESTIC} AS domestic, ({SCOPE_SCORE})::BIGINT AS scope, {_hits(lex.BROAD)} >= {_hits(lex.DEEP)} AS broad FROM texts""")
def item_features(spark, sf_dir):
    text = F.col(TEXT)
    scope = K.scope(text, lex.BROAD, lex.DEEP)
    return with_text(news(spark, sf_dir)).select(
        "id", K.fact_richness(text, F.coalesce("content", F.lit("")), lex.FACT_PATTERNS, lex.FACTS).cast("bigint").alias("facts"), K.domestic(text, lex.HOME, lex.ABROAD).alias("domestic"),
        scope["score"].cast("bigint").alias("scope"), scope["broad"].alias("broad"),
    )


def _any_in(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_lit(w)})" for w in words) + ")"


_EXEMPT = ", ".join(_lit(s) for s in lex.EXEMPT)
KEPT = f"""regexp_matches(coalesce(content, ''), '\\S') AND NOT {_any(lex.OPINION)}
    AND (source IN ({_EXEMPT}) OR NOT ({_any(lex.ADMINISTRATIVE)} OR {_any_in('title', lex.NOTICE).replace(' OR ', ' AND ')})) AND (regexp_matches(t, {_lit(lex.AMOUNTS)}) OR {_hits(lex.CONCRETE)} >= 2 OR length(title) > 15)
    AND NOT (regexp_matches(t, {_lit(lex.BRIEF)}) OR (length(title) < 20 AND length(content) < 100))"""


@query(f"""{_BASE} SELECT id, NOT {_any_in('title', lex.EXCLUDED)} AND ({_any_in('title', lex.STRONG)} OR {_hits(lex.WEAK).replace('contains(t,', 'contains(title,')} >= 2) AS relevant, {KEPT} AS kept FROM texts""")
def relevance_gate(spark, sf_dir):
    relevant = K.relevant(F.coalesce("title", F.lit("")), lex.EXCLUDED, lex.STRONG, lex.WEAK)
    return with_text(news(spark, sf_dir)).select("id", relevant.alias("relevant"), gate(lex).alias("kept"))


@query(f"""{SCORES} SELECT id, round(0.40 * (least((5 + 6 * {DOMESTIC}::INT + {FACTS}) / 40.0, 1.0) * 100) + 0.60 * round(least(({RAW}) * least({FACTOR}, 1.3::DOUBLE), 100.0), 2), 3) AS priority
    FROM scores WHERE {KEPT}""")
def priority_scores(spark, sf_dir):
    return filtered(news(spark, sf_dir), lex).select("id", F.round("priority_score", 3).alias("priority"))


_PARTS = ", ".join(f"CASE WHEN s_{name} > 0 THEN '{name}(' || s_{name} || ')' END" for name in K.WEIGHTS)
_APPLIED = [*((name, factor, _any(words)) for name, factor, words in lex.BOOSTERS), ("state", 1.2, "s_corporate >= 85 AND s_industry >= 80")]
_MARKS = ", ".join(f"CASE WHEN {on} THEN '{name}(x{factor})' END" for name, factor, on in _APPLIED)
_READ = ", ".join(f"CASE WHEN {on} THEN {{'name': '{name}', 'factor': '{factor}'}} END" for name, factor, on in _APPLIED)


@query(f"""{SCORES}, e AS (SELECT id, concat_ws(' + ', {_PARTS}) AS parts, concat_ws(' ', {_MARKS}) AS marks, list_filter([{_READ}], lambda x: x IS NOT NULL) AS boosters FROM scores)
    SELECT id, parts || CASE WHEN marks <> '' THEN ' [' || marks || ']' ELSE '' END AS explanation, len(boosters)::BIGINT AS n, array_to_string(list_transform(boosters, lambda x: x.name || ' ' || x.factor), ',') AS boosters FROM e""")
def score_explanations(spark, sf_dir):
    """Free text with the criteria and boosters (and the total, which other queries compare); the boosters are read back from it."""
    own = scored(news(spark, sf_dir), lex).select("id", "explanation", K.explained_boosters(F.col("explanation")).alias("boosters"))
    named = F.array_join(F.transform("boosters", lambda x: F.concat(x["name"], F.lit(" "), x["factor"])), ",")
    return own.select("id", F.regexp_replace("explanation", r" = [\d,.]+$", "").alias("explanation"), F.size("boosters").cast("bigint").alias("n"), named.alias("boosters"))


#: The criteria that are tiers of terms and nothing else, so that a table can hold them.
_TIERS = {"policy": lex.POLICY, "geography": lex.GEOGRAPHY, "time": lex.TIME, "international": lex.INTERNATIONAL, "social": lex.SOCIAL}
_LONG = " UNION ALL ".join(f"SELECT id, '{name}' AS criterion, s_{name}::BIGINT AS best FROM scores WHERE s_{name} > 0" for name in _TIERS)


@query(f"{SCORES} {_LONG}")
def score_by_term_table(spark, sf_dir):
    """Criteria from a lexicon that is a table, not a part of the plan: the same scores."""
    rows = [(name, score, term) for name, tiers in _TIERS.items() for score, terms in tiers for term in terms]
    lexicon = spark.createDataFrame(rows, "criterion string, score bigint, term string")
    found = terms_found(with_text(news(spark, sf_dir)), lexicon, text=TEXT, by=("criterion", "score"))
    return term_counts(found).select("id", "criterion", "best")


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS term FROM benchmark"


@query(f"""WITH {NEWS_SQL}, lexicon AS (SELECT term, substr(lower(term), 1, 1) AS criterion, length(term) * 5 AS score FROM ({_WORDS}))
    SELECT id, criterion, count(*)::BIGINT AS n, max(score)::BIGINT AS best FROM news JOIN lexicon ON contains(coalesce(content, ''), term) GROUP BY ALL""")
def large_lexicon_scores(spark, sf_dir):
    """A lexicon made from a table, some thousand terms, over all whole texts: distinct terms and the best score by first letter."""
    term = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1))).alias("term")
    lexicon = table(spark, sf_dir, "benchmark").select(term).distinct()
    lexicon = lexicon.select("term", F.left(F.lower("term"), F.lit(1)).alias("criterion"), (F.length("term") * 5).cast("bigint").alias("score"))
    return term_counts(terms_found(news(spark, sf_dir), lexicon, text="content", by=("criterion", "score"))).select("id", "criterion", "n", "best")
