"""Quality rules: per-document counts and cross-document line frequency, in DataFrame expressions only.

Lines are normalised (lower case, trimmed) and hashed. For every host (``source``) and line the operator counts the
distinct documents that hold it; equal texts of a host are one document, so its copies don't make its lines frequent.
Lines that more than ``max_docs`` documents of a host hold are removed, and a document is rejected if it fails the base
rules or if less than ``min_left`` of the characters in its lines stay. The text is read once: counts and line hashes
go to a scratch table, from which the rest is computed. There a line is first counted with its copies, which is one
partial aggregate; only lines above the limit by that count have their documents told apart.

Edge cases: a null text has no words and fails the base rules; a null ``source`` is a host of its own; rows that
repeat are judged each by itself and get the same verdict; an empty table gives an empty result; other columns are
passed through by ``filter_quality``, whatever their names, and ignored by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept, scratch_scope, spread, unused, written

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by a five-word window that is in the text twice or more."""

    def windows(h: Column) -> Column:
        own = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)]))
        return F.slice(own, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

        return _let(_let(ordered, places), total)

    def checked(w: Column) -> Column:
        # most texts repeat no window: comparing two sizes spares them the sort
        return F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0).cast("bigint")).otherwise(covered(w))

    return _let(_let(hashes, windows), checked)


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """docs with _q_whole (the text, null as empty) and the base counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.col("_q_whole")
    raw = F.transform(F.filter(F.split(whole, "\n"), lambda x: F.length(_without(x, " \t\x0b\f\r")) > 0), lambda x: F.xxhash64(x))
    return (
        docs.withColumn("_q_whole", F.coalesce(F.col(text), F.lit("")))
        .withColumns({"_q_hashes": _word_hashes(whole), "_q_raw": raw})
        .withColumns(
            {
                "n_words": F.size("_q_hashes").cast("bigint"),
                "word_chars": F.length(_without(whole, " \n\t\x0b\f\r")).cast("bigint"),
                "n_symbols": (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("bigint"),
                "n_dup_lines": (F.size("_q_raw") - F.size(F.array_distinct("_q_raw"))).cast("bigint"),
                "n_repeat_words": _repeat_words(F.col("_q_hashes")),
            }
        )
        .drop("_q_hashes", "_q_raw")
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _normalised(line: Column) -> Column:
    return F.trim(F.translate(F.lower(line), "\t\x0b\f\r", "    "))


def _line_hash(host: str, normalised: Column) -> Column:
    return F.xxhash64(F.col(host), normalised)


def _identity(key: str, text: str, host: str) -> Column:
    """Tells rows apart even where a key repeats or is null; equal rows share it."""
    return F.xxhash64(F.col(key), F.col(text), F.col(host))


def _scanned(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """The one pass over the texts: identity, key, counts, characters in lines, and for each line that isn't blank its hash and length."""
    lines = F.transform(
        F.filter(F.transform(F.split(_normalised(F.col("_q_whole")), "\n"), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.struct(_line_hash("_q_host", x).alias("line"), F.length(x).alias("chars")),
    )
    own = spread(docs.select(F.col(key).alias("_q_key"), F.col(text).alias("_q_text"), F.col(host).alias("_q_host")))
    counted = with_counts(own, "_q_text").withColumn("_q_lines", lines)
    return counted.select(
        "_q_key", _identity("_q_key", "_q_text", "_q_host").alias("_q_id"), F.xxhash64("_q_whole").alias("_q_doc"), *COUNTS,
        F.aggregate("_q_lines", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"]).alias("_q_all"), "_q_lines",
    )


def frequent_lines(scanned: DataFrame, max_docs: int) -> DataFrame:
    """Hashes of the lines that more than max_docs distinct documents of their host hold, as a table of its own."""
    rows = scanned.select("_q_doc", F.explode(F.array_distinct(F.transform("_q_lines", lambda x: x["line"]))).alias("_q_line"))
    often = written(rows.groupBy("_q_line").agg(F.count(F.lit(1)).alias("_q_n")).where(F.col("_q_n") > max_docs).select("_q_line"))
    held = rows.join(often, "_q_line").distinct()
    out = written(held.groupBy("_q_line").agg(F.count(F.lit(1)).alias("_q_n")).where(F.col("_q_n") > max_docs).select("_q_line"))
    dropped(often)
    return out


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, min_left: float = 0.3) -> DataFrame:
    """key, the base counts, line_chars (characters in lines above the limit), base_failed and kept of every row of docs."""
    with scratch_scope():
        judged = _judged(written(_scanned(docs, key, text, host)), max_docs, min_left)
        return kept(judged.select(F.col("_q_key").alias(key), *COUNTS, F.col("_q_lost").alias("line_chars"), "base_failed", "kept"))


def _judged(scanned: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """The scanned rows with their verdict; _q_hot holds the hashes of their lines above the limit."""
    lines = scanned.select("_q_id", F.posexplode("_q_lines").alias("_q_at", "_q_l")).select("_q_id", "_q_at", F.col("_q_l.line").alias("_q_line"), F.col("_q_l.chars").alias("_q_chars"))
    # places tell the lines of a document apart and are the same in rows that repeat it
    found = lines.join(frequent_lines(scanned, max_docs), "_q_line").groupBy("_q_id").agg(F.collect_set(F.struct("_q_at", "_q_line", "_q_chars")).alias("_q_found"))
    lost = found.select(
        "_q_id", F.array_distinct(F.transform("_q_found", lambda x: x["_q_line"])).alias("_q_hot"),
        F.aggregate("_q_found", F.lit(0).cast("bigint"), lambda a, x: a + x["_q_chars"]).alias("_q_lost"),
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (
        scanned.drop("_q_lines").join(lost, "_q_id", "left")
        .withColumns({"_q_lost": F.coalesce("_q_lost", F.lit(0).cast("bigint")), "base_failed": failed})
        .withColumn("kept", ~failed & (F.col("_q_all") - F.col("_q_lost") >= min_left * F.col("_q_all")))
    )


def filter_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20, min_left: float = 0.3) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns, without the lines above the limit in their text (n_chars follows)."""
    ident, hot = unused("_q_id", docs), unused("_q_hot", docs)
    with scratch_scope():
        judged = _judged(written(_scanned(docs, key, text, host)), max_docs, min_left)
        verdict = kept(judged.where("kept").select("_q_id", "_q_hot").dropDuplicates(["_q_id"])).toDF(ident, hot)
    out = docs.withColumn(ident, _identity(key, text, host)).join(verdict, ident)
    stay = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(hot, _line_hash(host, _normalised(x))))
    out = out.withColumn(text, F.when(F.col(hot).isNull(), F.col(text)).otherwise(F.array_join(stay, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hot).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


#: The digest query as DuckDB SQL (doc_id being unique there).
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, list_slice(words, i, i + 4) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY doc_id
), raw AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), lines AS (
    SELECT doc_id, source, text, trim(x, ' ') AS line, length(trim(x, ' ')) AS chars FROM (
        SELECT doc_id, source, text, unnest(string_split(trim(translate(lower(text), chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), chr(10))) AS x FROM d) WHERE trim(x, ' ') <> ''
), hot AS (
    SELECT source, line FROM (SELECT DISTINCT source, line, sha256(text) FROM lines) GROUP BY source, line HAVING count(*) > 20
), lost AS (
    SELECT l.doc_id, sum(l.chars) AS total, sum(CASE WHEN h.line IS NOT NULL THEN l.chars ELSE 0 END) AS gone
    FROM lines l LEFT JOIN hot h ON l.source IS NOT DISTINCT FROM h.source AND l.line = h.line GROUP BY l.doc_id
), counts AS (
    SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(raw.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.total, 0) AS total, coalesce(lost.gone, 0) AS gone
    FROM d LEFT JOIN raw USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND total - gone >= 0.3 * total AS kept FROM counts
"""
