"""Scoring by lexicons: which distinct keywords a text contains, as expressions over array literals.

A lexicon is data that the caller passes in; keywords are plain substrings, case-sensitive, and count once each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(keywords: list[str]) -> Column:
    return F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")


def found(text: Column, keywords: list[str]) -> Column:
    """The keywords in the text, in the lexicon's order."""
    return F.filter(words(keywords), lambda k: F.contains(text, k))


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords are in the text: a sum of plain tests, which Spark compiles."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in keywords], F.lit(0))


def any_of(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords], F.lit(False))


def all_of(text: Column, keywords: list[str]) -> Column:
    """All of the keywords are in the text; never for none."""
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(k)) for k in keywords]) if keywords else F.lit(False)


def exempt(source: Column, sources: list[str]) -> Column:
    """The source is one that administrative terms and notices don't count for; never for a null one."""
    return F.coalesce(source.isin(sources), F.lit(False)) if sources else F.lit(False)


def tier(text: Column, tiers: list[tuple[int, list[str]]]) -> Column:
    """The highest score among the tiers with a keyword in the text; 0 without. Lower tiers are only looked for without a higher one."""
    out = F.lit(0)
    for score, keywords in sorted(tiers, key=lambda t: t[0]):
        out = F.when(any_of(text, keywords), score).otherwise(out)
    return out


def bound(items: DataFrame, name: str, value: Column) -> DataFrame:
    """items with a column whose value is computed once for a row: neither projections nor filters that use it copy its expression, as they would a plain one's."""
    return items.withColumn(name, F.explode(F.array(value)))


def relevant(title: Column, excluded: list[str], strong: list[str], weak: list[str]) -> Column:
    """No excluded term, and a strong one or two weak ones."""
    return ~any_of(title, excluded) & (any_of(title, strong) | (hits(title, weak) >= 2))


def factual(text: Column, opinion: list[str], administrative: list[str], spared: Column) -> Column:
    """No term of opinion, whatever the source; and no administrative one, unless the source is exempt."""
    return ~any_of(text, opinion) & (spared | ~any_of(text, administrative))


def analytical(title: Column, text: Column, notice: list[str], amounts: str, concrete: list[str], spared: Column) -> Column:
    """Not a notice, which has all of its terms in the title, unless the source is exempt; and it has an amount, two concrete terms or a title of some length."""
    return (spared | ~all_of(title, notice)) & (text.rlike(amounts) | (hits(text, concrete) >= 2) | (F.length(title) > 15))


def brief(title: Column, content: Column, patterns: str) -> Column:
    return F.concat(title, content).rlike(patterns) | ((F.length(title) < 20) & (F.length(content) < 100))


def domestic(text: Column, home: list[str], abroad: list[str]) -> Column:
    return (hits(text, home) > hits(text, abroad)) | (hits(text, abroad) <= 1)


def category(text: Column, categories: dict[str, list[str]]) -> Column:
    """The category with most hits; of equals, and if none has any, the first."""
    scored = [F.struct(hits(text, keywords).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, keywords) in enumerate(categories.items())]
    return F.array_max(F.array(*scored))["name"]


def fact_richness(text: Column, content: Column, patterns: list[str], facts: list[str]) -> Column:
    """Up to 12 for number patterns and 8 for fact words, more for the content's length, less for its lack."""
    numbers = F.least(F.lit(12), 3 * reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns]))
    size = F.length(content)
    by_length = F.when(size > 500, 3).when(size > 250, 1).when(size < 50, -15).when(size < 100, -5).otherwise(0)
    return numbers + F.least(F.lit(8), 2 * hits(text, facts)) + by_length


def scope(text: Column, broad: list[str], deep: list[str]) -> Column:
    b, d = hits(text, broad), hits(text, deep)
    return F.when(b > d, F.struct((10 + b).alias("score"), F.lit(True).alias("broad"))).when(d > b, F.struct((5 - d).alias("score"), F.lit(False).alias("broad"))).otherwise(F.struct(F.lit(7).alias("score"), F.lit(True).alias("broad")))


# Thresholds of the amount in a text, and their scores.
AMOUNT_STEPS = ((1e11, 100), (1e10, 80), (1e9, 60), (1e8, 40))
AMOUNT_FLOOR = 20


@dataclass(frozen=True)
class Amounts:
    """How amounts are told: the largest unit and its factor, a word that stands for an amount without a number, a smaller unit, and the amount from which that isn't looked for."""

    largest: tuple[str, float]
    word: tuple[str, float]
    smaller: tuple[str, float]
    enough: float = 1e8


def amount_of(text: Column, amounts: Amounts) -> Column:
    """The most "number unit" in the largest unit; without any the word's amount; and if that isn't enough, the most in the smaller unit if it is more."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    most = lambda unit, factor: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?)\s*{unit}"), F.lit(1)), lambda x: x.cast("double") * factor)), F.lit(0.0))
    word, worth = amounts.word
    first = let(most(*amounts.largest), lambda x: F.when(x == 0, F.when(F.contains(text, F.lit(word)), F.lit(worth)).otherwise(0.0)).otherwise(x))
    return let(first, lambda x: F.when(x < amounts.enough, F.greatest(x, most(*amounts.smaller))).otherwise(x))


def economic_scale(text: Column, amounts: Amounts, bonuses: list[tuple[int, list[str]]]) -> Column:
    """A score for the amount (never less than the floor), more for scope words, 100 at most."""

    def base(amount: Column) -> Column:
        out = F.lit(AMOUNT_FLOOR)
        for least, score in reversed(AMOUNT_STEPS):
            out = F.when(amount >= least, score).otherwise(out)
        return out

    score = F.get(F.transform(F.array(amount_of(text, amounts)), base), F.lit(0))
    return F.least(F.lit(100), score + tier(text, bonuses))


@dataclass(frozen=True)
class Corporate:
    """Keywords of the corporate cascade."""

    state_owned: list[str]
    strategic: list[str]
    private: list[str]
    foreign: list[str]
    local: list[str]
    generic: list[str]


def corporate(text: Column, lexicon: Corporate) -> Column:
    """State-owned names (more with strategic ones), private, foreign, local and generic ones: the best of those that are there."""
    own = F.when(any_of(text, lexicon.state_owned), F.when(any_of(text, lexicon.strategic), 100).otherwise(85)).otherwise(0)
    others = [(80, lexicon.private), (60, [*lexicon.foreign, *lexicon.local]), (40, lexicon.generic)]
    return F.greatest(own, tier(text, others))


def industry(text: Column, floor_terms: list[str], tiers: list[tuple[int, list[str]]], floor: int = 80) -> Column:
    """The best tier, and at least the floor if a term of national supply is there."""
    return F.greatest(F.when(any_of(text, floor_terms), floor).otherwise(0), tier(text, tiers))


# The criteria's weights and the boosters' cap.
WEIGHTS = {"policy": 0.25, "corporate": 0.15, "industry": 0.20, "scale": 0.15, "geography": 0.10, "time": 0.05, "international": 0.05, "social": 0.05}
BOOST_CAP = 1.3


def weighted(scores: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [scores[name] * F.lit(weight) for name, weight in WEIGHTS.items()])


def boosters(text: Column, groups: list[tuple[str, float, list[str]]], extra: list[tuple[str, float, Column]]) -> Column:
    """array<struct<name, factor>> of those that apply; a group counts once."""
    every = [(name, factor, any_of(text, keywords)) for name, factor, keywords in groups] + extra
    return F.filter(F.array(*[F.when(on, F.struct(F.lit(name).alias("name"), F.lit(factor).alias("factor"))) for name, factor, on in every]), lambda x: x.isNotNull())


def boosted(raw: Column, applied: Column) -> Column:
    """Times the product of the factors, which is capped; 100 at most, two decimals."""
    factor = F.least(F.aggregate(applied, F.lit(1.0), lambda a, x: a * x["factor"]), F.lit(BOOST_CAP))
    return F.round(F.least(raw * factor, F.lit(100.0)), 2)


def explanation(scores: dict[str, Column], applied: Column, total: Column) -> Column:
    """"policy(80) + scale(20) [wide x1.5] = 41.0": criteria above zero, boosters, total."""
    parts = F.filter(F.array(*[F.when(c > 0, F.concat(F.lit(f"{name}("), c.cast("string"), F.lit(")"))) for name, c in scores.items()]), lambda x: x.isNotNull())
    marks = F.array_join(F.transform(applied, lambda x: F.concat(x["name"], F.lit("(x"), x["factor"].cast("string"), F.lit(")"))), " ")
    return F.concat(F.array_join(parts, " + "), F.when(F.size(applied) > 0, F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""), F.lit(" = "), F.format_number(total, 1))


def explained_boosters(text: Column) -> Column:
    """The inverse: the names and factors of an explanation."""
    names = F.regexp_extract_all(text, F.lit(r"(\w+)\(x([\d.]+)\)"), F.lit(1))
    return F.arrays_zip(names.alias("name"), F.regexp_extract_all(text, F.lit(r"(\w+)\(x([\d.]+)\)"), F.lit(2)).alias("factor"))


def formal(priority: Column, central: Column, home: Column, facts: Column) -> Column:
    """The formal score on a scale of 100."""
    return F.least((priority + 5 * central.cast("int") + 6 * home.cast("int") + facts) / 40.0, F.lit(1.0)) * 100


def priority(formal_score: Column, content_score: Column) -> Column:
    return 0.40 * formal_score + 0.60 * content_score
