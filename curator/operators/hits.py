"""Where rules hit: a table function over texts, for SQL and for frames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .safety import Rule

HITS = "id bigint, rule string, severity string, offset bigint, length bigint, found string, context string, fix string"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())


def hits_of(text: str, rules: list[Rule], around: int = 30) -> Iterator[tuple[str, str, int, int, str, str, str | None]]:
    """(rule, severity, offset in code points from 0, length, found, context, fix) of every hit, rule by rule in order."""
    for r in rules:
        for m in re.finditer(r.pattern, text, re.IGNORECASE):
            yield r.name, r.severity, m.start(), m.end() - m.start(), m[0], text[max(0, m.start() - around) : m.end() + around], r.fix


def hit_function(rules: list[Rule], around: int = 30):
    """A table function of a table (id bigint, text string): a row for each hit. A null text has none; texts come in Arrow batches."""

    class TextHits:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            out = [(i, *h) for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) if text for h in hits_of(text, rules, around)]
            names = [f.split(" ")[0] for f in HITS.split(", ")]
            yield pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * len(_KINDS), _KINDS)], names=names)

    return F.arrow_udtf(TextHits, returnType=HITS)


def registered(spark: SparkSession, name: str, rules: list[Rule], around: int = 30) -> str:
    """The function under a name for SQL: SELECT * FROM name(TABLE(SELECT id, text FROM ...))."""
    spark.udtf.register(name, hit_function(rules, around))
    return name


def hits(texts: DataFrame, rules: list[Rule], around: int = 30, key: str = "id", text: str = "text") -> DataFrame:
    """The hits in a frame's texts."""
    name = registered(texts.sparkSession, "text_hits", rules, around)
    return texts.sparkSession.sql(f"SELECT * FROM {name}(TABLE(SELECT CAST(`{key}` AS BIGINT) AS id, `{text}` AS text FROM {{texts}}))", texts=texts)
