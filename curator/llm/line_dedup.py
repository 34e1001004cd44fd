"""Line dedup: overlapping windows of three lines that occur earlier in the corpus are removed.

Every window of three consecutive lines with a word (blank lines between them don't count) is hashed after trimming.
The first occurrence of a window is the one of least key, and within it the one that begins first. All others are
repeats; their lines, and blank lines between, are covered, and the covered positions of a document, merged, are cut
out. The hashes go to a scratch table in one pass over the texts; what is then shuffled is a row for each window.

Edge cases: a null or empty text has no lines and stays; texts of fewer than three lines stay; a null key comes after
all others; rows that share a key are one document's copies, none earlier than the other at equal places; an empty
table gives an empty result; other columns pass through, whatever their names, but ``n_lines`` and ``n_removed`` are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch_scope, spread, unused, written

SPACE = " \t\r\x0b\f"


def _identity(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _windows(text: str, lines: int) -> Column:
    """array<struct<hash, from, to>> of the windows of a text; positions count all of its lines."""
    full = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(_trimmed(x).alias("line"), i.alias("at"))), lambda x: x["line"] != "")

    def windows(own: Column) -> Column:
        last = lines - 1
        all_starts = F.transform(
            own,
            lambda x, i: F.struct(
                F.xxhash64(x["line"], *[F.get(own, i + j)["line"] for j in range(1, lines)]).alias("hash"), x["at"].alias("from"), F.get(own, i + last)["at"].alias("to")
            ),
        )
        return F.slice(all_starts, F.lit(1), F.greatest(F.size(own) - last, F.lit(0)))

    return F.get(F.transform(F.array(full), windows), F.lit(0))


def repeated_lines(docs: DataFrame, key: str, text: str, lines: int) -> DataFrame:
    """(_l_id, _l_spans), a table: for every document with repeated windows, the spans of lines that they cover."""
    order = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"))
    own = spread(docs.select(_identity(key, text).alias("_l_id"), order.alias("_l_order"), F.col(text).alias("_l_text")))
    rows = written(own.select("_l_id", "_l_order", F.explode(_windows("_l_text", lines)).alias("_l_w")))
    rows = rows.select("_l_id", F.struct("_l_order", F.col("_l_w.from").alias("at")).alias("_l_place"), F.col("_l_w.hash").alias("_l_hash"), F.col("_l_w.to").alias("_l_to"))
    # a table of its own, joined in one way at every size: Spark then splits the hot windows of large inputs
    first = written(rows.groupBy("_l_hash").agg(F.min("_l_place").alias("_l_first"), F.count(F.lit(1)).alias("_l_n")).where("_l_n > 1").drop("_l_n"))
    later = rows.join(first.hint("merge"), "_l_hash").where("_l_place > _l_first")
    return kept(later.groupBy("_l_id").agg(F.collect_set(F.struct(F.col("_l_place.at").alias("from"), F.col("_l_to").alias("to"))).alias("_l_spans")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", lines: int = 3) -> DataFrame:
    """docs without their repeated lines, with n_lines (before) and n_removed; n_chars, where there is one, follows."""
    ident, spans, own, stay = (unused(x, docs) for x in ("_l_id", "_l_spans", "_l_own", "_l_stay"))
    with scratch_scope():
        found = repeated_lines(docs, key, text, lines).toDF(ident, spans).hint("merge")
    joined = docs.withColumn(ident, _identity(key, text)).join(found, ident, "left")
    covered = F.flatten(F.transform(spans, lambda s: F.sequence(s["from"], s["to"])))
    hit = F.col(spans).isNotNull()
    out = (
        joined.withColumn(own, F.split(F.col(text), "\n"))
        .withColumn(stay, F.when(hit, F.array_except(F.sequence(F.lit(0), F.size(own) - 1), covered)))
        .withColumns(
            {
                "n_lines": F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(own)).cast("bigint"),
                "n_removed": F.when(hit, F.size(own) - F.size(stay)).otherwise(0).cast("bigint"),
                text: F.when(hit, F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")).otherwise(F.col(text)),
            }
        )
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


#: The digest query as DuckDB SQL.
ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), full_lines AS (
    SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
), windows AS (
    SELECT a.doc_id, a.pos AS lo, c.pos AS hi, a.line || chr(10) || b.line || chr(10) || c.line AS w
    FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.k = a.k + 2
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, lo) AS r FROM windows
), covered AS (
    SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN ranked r ON l.doc_id = r.doc_id AND r.r > 1 AND l.pos BETWEEN r.lo AND r.hi
), kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
    WHERE c.doc_id IS NULL GROUP BY l.doc_id
), counts AS (
    SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(length(d.text), 0) = 0 THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
    coalesce(c.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
