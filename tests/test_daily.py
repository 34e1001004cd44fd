"""The data source of texts by day: visibility, replacement, pruning, streams, retention."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from curator.sources import daily as Y

DAY = datetime.date(2024, 1, 1)
DAYS = [DAY + datetime.timedelta(i) for i in range(4)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "day date, name string, text string")


def seen(df):
    return sorted(((r.day, r.name, r.text) for r in df.collect()), key=str)


def some(spark, tag, days=DAYS, n=5):
    return frame(spark, [(d, f"news_{i}.md", f"# {tag} {i} é\n{d}") for d in days for i in range(n)])


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(DAY, "a/../b.md", "x"), (DAY, "a", None), (None, "n.md", "no day"), (DAY, None, ""), (DAY, "same", "1"), (DAY, "same", "2"), (DAY, "é" * 300, "long name"), (DAY, "..", "dots")]
    path = str(tmp_path)
    assert Y.read_texts(spark, path).collect() == []
    Y.write_texts(frame(spark, rows).withColumn("commit", F.lit("clash")), path)
    assert seen(Y.read_texts(spark, path)) == sorted([(d, n or "", t) for d, n, t in rows], key=str)
    Y.write_texts(frame(spark, []), path)
    assert len(Y.commits(path)) == 1  # nothing written, nothing committed
    with pytest.raises(Exception, match="no column text"):
        frame(spark, rows).drop("text").write.format(Y.FORMAT).option("path", path).mode("append").save()


def test_replacing_days(spark, tmp_path):
    path = f"file://{tmp_path}"
    Y.write_texts(some(spark, "old"), path)
    Y.write_texts(some(spark, "new", DAYS[1:2], 3), path, replace=True)
    Y.write_texts(some(spark, "more", DAYS[1:2], 1), path)
    got = seen(Y.read_texts(spark, path))
    want = seen(some(spark, "old", [DAYS[0], *DAYS[2:]])) + seen(some(spark, "new", DAYS[1:2], 3)) + seen(some(spark, "more", DAYS[1:2], 1))
    assert got == sorted(want, key=str)
    assert Y.read_texts(spark, path).where("commit > 1").count() == 4


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path)
    Y.write_texts(some(spark, "x", DAYS, 50), path)
    reader = Y.Reader(path)
    assert list(reader.pushFilters([Y.D.EqualTo(("day",), DAYS[2]), Y.D.StringContains(("text",), "x")])) == [Y.D.StringContains(("text",), "x")]
    parts = reader.partitions()
    assert parts and all(p.days == [DAYS[2].isoformat()] for p in parts)
    assert len(parts) < len(Y.Reader(path).partitions())
    for file in tmp_path.glob(f"{DAYS[0]}/*/*"):
        file.unlink()  # a read that opened it would fail
    assert Y.read_texts(spark, path).where(F.col("day") >= DAYS[1]).count() == 150
    assert Y.read_texts(spark, path).where(F.col("day").isin(DAYS[1], DAYS[3]) & F.col("text").contains("x 7")).count() == 2
    assert Y.read_texts(spark, path).where(F.col("day") > DAYS[3]).count() == 0


def test_a_failed_write_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path)
    Y.write_texts(some(spark, "kept"), path)
    before = seen(Y.read_texts(spark, path))
    bad = some(spark, "lost", DAYS, 40).withColumn("text", F.when(F.col("name") == "news_39.md", F.raise_error("on purpose")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="on purpose"):
        bad.write.format(Y.FORMAT).option("path", path).mode("overwrite").save()
    assert seen(Y.read_texts(spark, path)) == before and len(Y.commits(path)) == 1
    # nor does one that is cut off before its commit
    writer = Y.Writer(path, True)
    os.makedirs(f"{path}/_commits", exist_ok=True)
    (tmp_path / "_commits" / f"_{writer.token}").write_text("half")
    assert seen(Y.read_texts(spark, path)) == before


def test_stream_reads_each_commit_once(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "texts"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        rows = Y.stream_texts(spark, path)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    Y.write_texts(some(spark, "one"), path)
    assert seen(run()) == seen(some(spark, "one"))
    Y.write_texts(some(spark, "two", DAYS[:1]), path, replace=True)
    Y.write_texts(some(spark, "three", DAYS[3:]), path)
    every = run()
    assert every.count() == 30 and {r.commit for r in every.select("commit").distinct().collect()} == {1, 2, 3}
    assert run().count() == 30


def test_retention(spark, tmp_path):
    path = str(tmp_path)
    for tag in ("a", "b", "c"):
        Y.write_texts(some(spark, tag).coalesce(1), path, replace=True)
    files = lambda: len(list(tmp_path.glob("2024-*/*/*")))
    assert files() == 60
    assert Y.expire(spark, path, keep=1) >= 1 and files() == 40  # a is replaced by b, c is the last
    assert seen(Y.read_texts(spark, path)) == seen(some(spark, "c"))
    assert Y.expire(spark, path, keep=1) == 0
    assert Y.expire(spark, path, keep=0) >= 1 and files() == 20
    assert seen(Y.read_texts(spark, path)) == seen(some(spark, "c"))
