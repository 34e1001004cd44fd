"""A state machine over a stream, with states that end by themselves.

Events may come late and in any order within the watermark's lateness: each waits in its key's state until the watermark
has passed it, then takes its turn in order of time: a timer a key, set for the first of them. A state that expires does so by an event-time timer, between the
events before and after. So what the stream has said when it stops is what a batch over the same events says as of its
watermark. A key holds its machine and what waits, not its log.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Machine(StatefulProcessor):
    """Moves (state, event) -> state and expiring states {state: (milliseconds, state after)}; other events change nothing."""

    def __init__(self, start: str, moves: dict[tuple[str, str], str], expiring: dict[str, tuple[int, str]]):
        self.start, self.moves, self.expiring = start, moves, expiring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, since bigint")
        self.waiting = handle.getListState("waiting", "at array<bigint>, place array<bigint>, event array<string>")  # an entry is a batch's events

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = [int(a) for a in part["at"]]
            self.waiting.appendValue((at, [int(p) for p in part["place"]], list(part["event"])))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first)  # when it ends, what waits then sets the next one
        return iter(())

    def _expired(self, state: str, since: int, now: int) -> tuple[str, int]:
        while state in self.expiring and since + self.expiring[state][0] <= now:
            since += self.expiring[state][0]
            state = self.expiring[state][1]
        return state, since

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed at once: a timer that is set now for a time before it would only fire in a later batch
        now = timerValues.getCurrentWatermarkInMs()
        known = self.machine.get()
        state, since = known if known is not None else (self.start, now)
        waiting = [w for entry in self.waiting.get() for w in zip(*entry)]
        due = sorted(w for w in waiting if w[0] <= now)
        out = []
        for at, _, event in due:
            state, since = self._expired(state, since, at)
            after = self.moves.get((state, event), state)
            if after != state:
                state, since = after, at
        state, since = self._expired(state, since, now)
        if due:
            left = [w for w in waiting if w[0] > now]
            if left:
                self.waiting.put([tuple(map(list, zip(*left)))])
                self.handle.registerTimer(min(left)[0])
            else:
                self.waiting.clear()
        if known is None or (state, since) != tuple(known):
            self.machine.update((state, since))
            out.append((*key, state, since, now))
            if state in self.expiring:
                self.handle.registerTimer(since + self.expiring[state][0])
        if out:
            yield pd.DataFrame(out, columns=["key", "state", "since", "at"])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers need a state store that keeps column families."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def milliseconds(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def run_machine(events: DataFrame, target: str, checkpoint: str, key: str, event: str, time: str, place: str, start: str, moves: dict, expiring: dict, lateness: str = "2 days") -> None:
    """Appends (key, state, since, at) whenever a key's state changes, to the end of what is there. Of events of one time, the lesser place goes first."""
    spark = events.sparkSession
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    rows = timed.select(F.col(key).alias("key"), "_time", milliseconds(F.col(time)).alias("at"), F.col(place).cast("bigint").alias("place"), F.col(event).alias("event"))
    kind = events.schema[key].dataType.simpleString()
    states = rows.groupBy("key").transformWithStateInPandas(Machine(start, moves, expiring), f"key {kind}, state string, since bigint, at bigint", "Update", "EventTime")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with _rocksdb(spark):
        query = states.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def last_states(spark: SparkSession, target: str) -> DataFrame:
    """(key, state, since) as the stream last said."""
    return spark.read.parquet(target).groupBy("key").agg(F.max_by("state", F.struct("at", "since")).alias("state"), F.max_by("since", F.struct("at", "since")).alias("since"))
