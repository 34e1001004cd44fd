"""Rule tables over text: findings by severity, fixes, and what blocks publication."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import once

SEVERITIES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    pattern: str
    fix: str | None = None


def findings(text: Column, rules: list[Rule], around: int | None = 30) -> Column:
    """array<struct<rule, severity, hits, found, contexts>> of the rules that match, in order.

    found holds every hit's text, contexts what stands around each, line ends included; null if around is None. A rule is only
    run over texts that hold one of the plain texts that its hits begin with, if its pattern tells them; what is around a hit is
    cut from the pieces between hits, so each such rule reads a text twice.
    """

    def among(lowered: Column) -> Column:
        return F.filter(F.array(*[_finding(text, lowered, r, around) for r in rules]), lambda x: x.isNotNull())

    return once(F.coalesce(F.lower(text), F.lit("")), among)


def beginnings(pattern: str) -> list[str] | None:
    """Plain texts in lower case, with one of which each hit of a pattern of alternatives begins; None where that can't be told."""
    out = []
    for part in pattern.split("|"):
        plain, rest = re.match(r"([A-Za-z0-9 !=_,;:@#%&~'\"-]*)(.*)", part, re.DOTALL).groups()
        plain = plain[:-1] if rest[:1] in ("?", "*", "{") else plain
        out.append(plain.lower())
    return None if re.search(r"[()\[\]]", pattern) or "" in out else out


def _finding(text: Column, lowered: Column, rule: Rule, around: int | None) -> Column:
    pattern = f"(?i)(?:{rule.pattern})"
    contexts = lambda own, between: F.transform(
        own, lambda x, i: F.concat(F.right(F.get(between, i), F.lit(around)), x, F.left(F.get(between, i + 1), F.lit(around)))
    )
    seen = lambda own: F.lit(None).cast("array<string>") if around is None else contexts(own, F.split(text, pattern, -1))
    made = lambda own: F.when(
        F.size(own) > 0, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), F.size(own).alias("hits"), own.alias("found"), seen(own).alias("contexts"))
    )
    plain = beginnings(rule.pattern)
    likely = text.rlike(pattern) if plain is None else reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in plain])
    return F.when(likely, once(F.regexp_extract_all(text, F.lit(f"(?i)({rule.pattern})"), F.lit(1)), made))


def count_of(found: Column, severity: str) -> Column:
    return F.aggregate(F.filter(found, lambda x: x["severity"] == severity), F.lit(0), lambda a, x: a + x["hits"])


def blocked(found: Column) -> Column:
    return F.exists(found, lambda x: x["severity"] == "critical")


def publishable(found: Column) -> Column:
    return ~F.exists(found, lambda x: x["severity"].isin("critical", "high"))


def fixed(text: Column, found: Column, rules: list[Rule]) -> Column:
    """What the rules with a fix found replaced, literally, in the order of rules and hits, each in what the one before left."""
    fixes = [r for r in rules if r.fix is not None]
    if not fixes:
        return text
    table = F.create_map(*[F.lit(x) for r in fixes for x in (r.name, r.fix)])
    hits = F.flatten(F.transform(F.filter(found, lambda x: x["rule"].isin([r.name for r in fixes])), lambda x: F.transform(x["found"], lambda y: F.struct(y.alias("old"), F.element_at(table, x["rule"]).alias("new")))))
    return F.aggregate(hits, text, lambda t, h: F.replace(t, h["old"], h["new"]))


def report(found: Column) -> Column:
    """One line for each severity that has findings."""
    lines = [_line(found, s) for s in SEVERITIES]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _line(found: Column, severity: str) -> Column:
    own = F.filter(found, lambda x: x["severity"] == severity)
    return F.when(F.size(own) > 0, F.concat(F.lit(f"{severity}: "), F.array_join(F.transform(own, lambda x: F.concat(x["rule"], F.lit(" x"), x["hits"].cast("string"))), ", ")))
