"""Ordered rewriting of titles, their validation, headlines and Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import squeezed, stripped


def without_prefixes(title: Column, prefixes: list[str]) -> Column:
    """Each prefix is tried once, in order."""
    for p in prefixes:
        title = F.when(F.startswith(title, F.lit(p)), F.trim(F.substr(title, F.lit(len(p) + 1)))).otherwise(title)
    return title


def with_dictionary(title: Column, terms: dict[str, str]) -> Column:
    """Longest term first; later replacements see what earlier ones made."""
    for old in sorted(terms, key=lambda k: (-len(k), k)):
        title = F.replace(title, F.lit(old), F.lit(terms[old]))
    return title


def with_patterns(title: Column, patterns: list[tuple[str, str]]) -> Column:
    for old, new in patterns:
        title = F.regexp_replace(title, old, new)
    return title


def validated(title: Column, corrections: list[tuple[str, str]], ambiguous: list[tuple[str, str]]) -> Column:
    """struct<title, corrections, warnings>: corrections in order, and warnings for patterns that remain."""
    steps = [title]
    for old, new in corrections:
        steps.append(F.regexp_replace(steps[-1], old, new))
    made = F.filter(F.array(*[F.when(a.rlike(old), F.lit(f"{old} -> {new}")) for (old, new), a in zip(corrections, steps)]), lambda x: x.isNotNull()) if corrections else F.array().cast("array<string>")
    warned = F.filter(F.array(*[F.when(steps[-1].rlike(p), F.lit(w)) for p, w in ambiguous]), lambda x: x.isNotNull()) if ambiguous else F.array().cast("array<string>")
    return F.struct(steps[-1].alias("title"), made.alias("corrections"), warned.alias("warnings"))


def postprocessed(title: Column, prefixes: list[str], terms: dict[str, str], corrections: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> Column:
    """struct<title, changed>: prefixes, dictionary, corrections, patterns, white space, in this order."""
    out = with_dictionary(without_prefixes(title, prefixes), terms)
    out = squeezed(with_patterns(validated(out, corrections, [])["title"], patterns))
    return F.struct(out.alias("title"), (out != title).alias("changed"))


def rewriting_rules(prefixes: list[str], terms: dict[str, str], corrections: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(kind, old, new) in the order in which postprocessed() applies them."""
    longest = sorted(terms, key=lambda k: (-len(k), k))
    return [*(("prefix", p, "") for p in prefixes), *(("term", t, terms[t]) for t in longest), *(("correction", a, b) for a, b in corrections), *(("pattern", a, b) for a, b in patterns)]


def rewritten(title: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<title, log>: a fold over the rules whose state is the text and what was done to it.

    Each rule sees what the last one left; log has (kind, old, new, title) for each that changed something, in order. Rules are
    data, so their number doesn't make the plan larger. White space is squeezed at the end, which isn't logged.
    """
    entry = "struct<kind:string,old:string,new:string,title:string>"
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("old"), F.lit(b).alias("new")) for k, a, b in rules]) if rules else F.array().cast("array<struct<kind:string,old:string,new:string>>")

    def step(s: Column, r: Column) -> Column:
        text = s["title"]
        cut = F.when(F.startswith(text, r["old"]), F.trim(F.substr(text, F.length(r["old"]) + 1))).otherwise(text)
        after = F.when(r["kind"] == "prefix", cut).when(r["kind"] == "term", F.replace(text, r["old"], r["new"])).otherwise(F.regexp_replace(text, r["old"], r["new"]))
        done = F.struct(r["kind"].alias("kind"), r["old"].alias("old"), r["new"].alias("new"), after.alias("title"))
        return F.when(after == text, s).otherwise(F.struct(after.alias("title"), F.concat(s["log"], F.array(done)).alias("log")))

    start = F.struct(title.alias("title"), F.array().cast(f"array<{entry}>").alias("log"))
    # a null title compares as null and would lose its log: it has none
    return F.when(title.isNotNull(), F.aggregate(every, start, step, lambda s: F.struct(squeezed(s["title"]).alias("title"), s["log"].alias("log"))))


def headline(title: Column, prefixes: list[str], forbidden: list[str], length: int = 18) -> Column:
    """A card's headline without a model: quotes and forbidden phrases out, cut with an ellipsis."""
    text = F.regexp_replace(without_prefixes(title, prefixes), "[\"'`]", "")
    for phrase in forbidden:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    text = squeezed(text)
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length - 1), F.lit("…")))


def section(markdown: Column, heading: str) -> Column:
    """What stands under a heading until a rule or the next heading, without comment lines."""
    body = F.regexp_extract(markdown, rf"(?s)(?:^|\n)## {heading}[^\n]*\n(.*?)(?=\n---|\n## |$)", 1)
    return stripped(F.array_join(F.filter(F.split(body, "\n"), lambda line: ~line.startswith("<!--")), "\n"))


def with_section(markdown: Column, heading: str, text: Column) -> Column:
    """markdown with what stands under a heading replaced; a heading that isn't there comes at the end."""
    pattern = rf"(?s)\A((?:.*?\n)??## {heading}[^\n]*\n)(.*?)((?:\n---|\n## ).*|)\z"
    part = lambda i: F.regexp_extract(markdown, pattern, i)
    return F.when(part(1) != "", F.concat(part(1), text, part(3))).otherwise(F.concat(markdown, F.lit(f"\n## {heading}\n"), text, F.lit("\n")))


def review_document(title: Column, source: Column, comment: Column) -> Column:
    """A review as Markdown."""
    return F.concat(F.lit("# "), title, F.lit("\n\n## Source\n"), source, F.lit("\n\n## Comment\n<!-- write below -->\n"), F.coalesce(comment, F.lit("")), F.lit("\n\n---\n"))
