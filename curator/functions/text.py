"""Scalar expressions over text, dates and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, however often use names it: Catalyst would copy its expression to each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_more_than_spaces(text: Column) -> Column:
    """Not null and not only spaces: other white space counts as text."""
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_text(text: Column) -> Column:
    """Not null and not only white space of any kind."""
    return stripped(F.coalesce(text, F.lit(""))) != ""


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def number_or(value: Column, default: float) -> Column:
    """Zero counts as missing."""
    return F.coalesce(F.when(value != 0, value), F.lit(default))


def squeezed(text: Column) -> Column:
    """White space squeezed and trimmed, none before closing punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" ([,.!?;:])", "$1")


def escaped_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def importance_badge(score: Column) -> Column:
    """Null counts as lowest."""
    return F.when(score >= 0.8, "very high").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


def stars(score: Column) -> Column:
    return F.repeat(F.lit("*"), F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 5).cast("int"))


def day_bucket(ts: Column, as_of: str) -> Column:
    day = F.to_date(ts)
    now = F.lit(as_of).cast("date")
    return F.when(day == now, "today").when(day == F.date_sub(now, 1), "yesterday").otherwise("earlier")


def edition(ts: Column) -> Column:
    """Half-open windows of the day; the last two hours belong to none."""
    hour = F.hour(ts)
    return F.when(hour < 7, "morning").when(hour < 14, "afternoon").when(hour < 22, "evening").otherwise("none")


def current_edition(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour < 7, "morning").when(hour < 14, "afternoon").otherwise("evening")


def relative_time(text: Column, as_of: Column) -> Column:
    """"just now", "3 minutes|hours|days ago", a date or a date and time; else null."""
    amount = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    ago = lambda unit: as_of - F.expr("interval 1 second") * (F.coalesce(amount, F.lit(0)) * unit)
    return (
        F.when(text == "just now", as_of)
        .when(text.rlike(r"^\d+ minutes? ago$"), ago(60))
        .when(text.rlike(r"^\d+ hours? ago$"), ago(3600))
        .when(text.rlike(r"^\d+ days? ago$"), ago(86400))
        .otherwise(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz"))
    )


def date_in_url(url: Column, first: str = "2020-01-01", last: str = "2030-12-31") -> Column:
    """The first of yyyy-mm/dd, yyyymmdd, yyyy/mm/dd, yyyy/mmdd and yyyy-mm in a URL that is a date in range; a month alone is its first day."""
    forms = (
        (r"/(20\d{2})-(\d{2})/(\d{2})/", 3), (r"/(20\d{2})(\d{2})(\d{2})(?:/|\.|_)", 3), (r"/(20\d{2})/(\d{2})/(\d{2})(?:/|\.|$)", 3),
        (r"/(20\d{2})/(\d{2})(\d{2})/", 3), (r"/(20\d{2})-?(\d{2})/", 2),
    )
    found = []
    for pattern, groups in forms:
        parts = [F.regexp_extract(url, pattern, i + 1) for i in range(groups)] + [F.lit("01")] * (3 - groups)
        day = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
        found.append(F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day))
    return F.coalesce(*found)


def _object_pattern(depth: int) -> str:
    """A balanced object with at most so many others around each other inside; its parts never give back what they took, so a text is read once."""
    inner = rf"|{_object_pattern(depth - 1)}" if depth else ""
    return rf'\{{(?:[^{{}}"\\]++|\\.|"(?:[^"\\]++|\\.)*+"{inner})*+\}}'


#: The first brace of a text, and the object that it opens if few others are in it.
_OBJECT = rf"(?s)\A[^{{]*+({_object_pattern(4)})"


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text: from its first brace to the one that closes it; null if none does.

    Braces inside strings don't count, nor do quotes behind a backslash. One pattern reads objects of a few levels; others, and
    what isn't closed, are read by a fold.
    """
    plain = lambda t: F.regexp_extract(t, _OBJECT, 1)
    return once(text, lambda t: F.when(F.contains(t, F.lit("}")), once(plain(t), lambda o: F.when(o != "", o).otherwise(_folded_object(t)))))


def _folded_object(text: Column) -> Column:
    """first_object() of any depth.

    Pieces begin at each brace, quote and backslash, and a fold over them keeps depth, whether in a string, and how far the
    object reaches.
    """
    state = lambda depth, quoted, size, done: F.struct(depth.alias("depth"), quoted.alias("quoted"), size.alias("size"), done.alias("done"))

    def step(s: Column, piece: Column) -> Column:
        quoted = F.when(piece == '"', ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(~s["quoted"] & (piece == "{"), 1).when(~s["quoted"] & (piece == "}"), -1).otherwise(0)
        return F.when(s["done"], s).otherwise(once(depth, lambda d: state(d, quoted, s["size"] + F.length(piece), d == 0)))

    def read(rest: Column) -> Column:
        # an escaped character goes with its backslash
        pieces = F.regexp_extract_all(rest, F.lit(r'(?s)(\\.|[{}"]|[^{}"\\]+|\\)'), F.lit(1))
        zero = state(F.lit(0), F.lit(False), F.lit(0), F.lit(False))
        return F.aggregate(pieces, zero, step, lambda end: F.when(end["done"], F.left(rest, end["size"])))

    return once(F.regexp_extract(text, r"(?s)(\{.*)", 1), lambda rest: F.when(rest != "", read(rest)))


_BLOCK = r"(?s)```(?:json)?\s*(.*?)```"


def fenced_json(text: Column) -> Column:
    """The first balanced object inside a ```json block, or else of the whole text; of a block that holds none, its inside."""
    inside = lambda block: F.coalesce(first_object(block), stripped(block))
    return once(text, lambda t: once(F.regexp_extract(t, _BLOCK, 1), lambda block: F.when(block != "", inside(block)).otherwise(first_object(t))))


def answered(text: Column, name: str) -> Column:
    """A field of an answer's object as JSON: of the one in a fenced block if it has the field, else of the text's first balanced one."""
    field = lambda t: F.get_json_object(first_object(t), f"$.{name}")
    return once(text, lambda t: F.coalesce(field(F.regexp_extract(t, _BLOCK, 1)), field(t)))


def listed_items(text: Column, name: str, none: str, shorter: int = 50) -> Column:
    """The items that a free text lists: those of a JSON object's field, else of a JSON array, else its lines without bullets, but for long ones; one item `none` if there are none."""
    field = F.from_json(F.regexp_extract(text, rf'(\{{[^{{}}]*"{name}"[^{{}}]*\}})', 1), f"{name} array<string>")[name]
    array = F.from_json(F.regexp_extract(text, r"(\[[^\[\]]+\])", 1), "array<string>")
    plain = lambda x: F.regexp_replace(F.trim(x, F.lit(" \t\r")), r"^[\d.\-*•]+\s*", "")
    lines = F.filter(F.transform(F.split(text, "\n"), plain), lambda x: (x != "") & (F.length(x) < shorter))
    return F.coalesce(field, array, F.when(F.size(lines) > 0, lines), F.array(F.lit(none)))


def merged_terms(*terms: Column) -> Column:
    """Maps put over each other: of equal keys the last map's value stays."""
    out = terms[0]
    for more in terms[1:]:
        out = _put_over(out, more)
    return out


def _put_over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]*)", 1))


def extension_allowed(name: Column, allowed: list[str]) -> Column:
    return name.contains(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(allowed)


def safe_html(text: Column, allowed: tuple[str, ...] = ("b", "i", "em", "strong", "p", "br", "ul", "ol", "li")) -> Column:
    """Only allowed elements, without attributes; scripts go with their content; plain text keeps its line breaks."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    out = F.regexp_replace(out, rf"(?i)<(/?)({'|'.join(allowed)})(?:\s[^>]*)?/?>", "\x01$1$2\x02")
    out = F.translate(F.regexp_replace(out, r"<[^>]*>", ""), "\x01\x02", "<>")
    return F.when(F.contains(text, F.lit("<")), out).otherwise(F.replace(text, F.lit("\n"), F.lit("<br>")))
