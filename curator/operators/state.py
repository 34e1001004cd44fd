"""State as immutable snapshots: upserts, guards, transitions and expiry are functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The incoming rows to append: of each key the first, unless it is there already."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = incoming.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.join(existing.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """existing with the incoming rows put over those of equal key; of several incoming ones the newest wins."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    last = incoming.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def patched(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with the given columns replaced where changes has a row and a value: null keeps the old one."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def where_set(table: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """table with columns set in the rows that fulfil the predicate (compare-and-set, expiry, marking)."""
    return table.withColumns({c: F.when(predicate, v).otherwise(F.col(c)) for c, v in values.items()})


def guarded(reviews: DataFrame, items: DataFrame, key: str, item_key: str, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """Incoming reviews split into accepted and rejected: an item in an allowed state must exist."""
    open_items = items.where(allowed).select(F.col(item_key).alias(key)).distinct()
    return reviews.join(open_items, key, "left_semi"), reviews.join(open_items, key, "left_anti")


def latest(log: DataFrame, key: str, newest: list[Column]) -> DataFrame:
    """The newest row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def numbered_after(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """incoming with keys that follow the largest one in use, in the given order.

    Numbers come from a count per range of a range-partitioned sort and a number within it, so the rows are never in one task.
    """
    start = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("start"))
    parts = written(incoming.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_at")))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    numbered = inside.join(F.broadcast(before), "_part").join(F.broadcast(start))  # one row for each partition; one row
    return numbered.withColumn(key, F.col("start") + F.col("_before") + F.col("_n")).drop("_part", "_at", "_n", "_before", "start")


def setting(settings: DataFrame, name: str, default: str, key: str = "setting_key", value: str = "setting_value", newest: str = "updated_at") -> DataFrame:
    """One row with a setting's newest value or the default."""
    return settings.where(F.col(key) == name).agg(F.coalesce(F.max_by(value, newest), F.lit(default)).alias(value))


def retained(files: DataFrame, modified: str, as_of: str, days: int) -> DataFrame:
    """The backups that a retention policy keeps."""
    return files.where(F.col(modified) >= F.expr(f"timestamp_ntz'{as_of}'") - F.expr(f"interval {int(days)} days"))


def replayed(log: DataFrame, key: str, event: str, order: list[str], start: str, moves: dict[tuple[str, str], str], piece: int = 1024) -> DataFrame:
    """(key, state): where each key's events, in order, lead by the allowed moves (state, event) -> state; others change nothing.

    A run of events is what it makes of every state, and two runs that follow each other are one again. The log is dealt
    by ranges of key and order, so a key of any size is in many tasks; runs of at most `piece` rows are folded, until a
    key has no more than that. A null event changes nothing, a null key is one of its own.
    """
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    table = F.create_map(*[F.lit(x) for (s, e), to in moves.items() for x in (f"{s}>{e}", to)])
    same = F.array(*map(F.lit, states))
    place = lambda s: (F.array_position(same, s) - 1).cast("int")
    moved = lambda to, e: F.transform(to, lambda s: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), e)), s))
    joined = lambda to, run: F.transform(to, lambda s: F.get(run, place(s)))

    def folded(rows: DataFrame, by: list[str], value: str, step, tasks: int) -> DataFrame:
        """(key, _at, _to) of each run of rows that lie together; a row's number counts within its range, and ranges count first."""
        dealt = rows.repartitionByRange(tasks, key, *by).sortWithinPartitions(key, *by).withColumn("_n", F.monotonically_increasing_id())
        runs = dealt.groupBy(key, F.floor(F.col("_n") / piece).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("_v")))).alias("_run"))
        return written(runs.select(key, "_at", F.aggregate("_run", same, lambda to, x: step(to, x["_v"])).alias("_to")))

    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = folded(log.select(key, *order, F.col(event).alias("_e")), order, "_e", moved, tasks)
    while True:
        most, n = runs.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
        if (most or 0) <= piece:
            break
        # many runs a task, else a key that lies in all tasks would have a run of each for ever
        before, runs = runs, folded(runs, ["_at"], "_to", joined, max(1, min(tasks, n // (16 * piece))))
        dropped(before)
    every = runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_to"))).alias("_run"))
    return every.select(key, F.get(F.aggregate("_run", same, lambda to, x: joined(to, x["_to"])), F.lit(states.index(start))).alias("state"))


def pending(items: DataFrame, waits: Column, key: str = "id", most: int = 50, each: int = 10) -> DataFrame:
    """The rows of one run: the newest by key of those that wait, at most `most` (the run's size), with batch, counted from 0 by `each` rows. Rows of one key are in any order."""
    run = items.where(waits).orderBy(F.desc(key)).limit(most)  # bounded, so one task may number it
    return run.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(F.desc(key))) - 1) / each).cast("bigint"))
