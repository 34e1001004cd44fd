"""The index of kept keys, and streams with state, against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from curator.streaming.index import KeyIndex, bytes_of


def digests(spark, values):
    return spark.createDataFrame([(hashlib.sha256(str(v).encode()).hexdigest(),) for v in values], "digest string")


def test_index_finds_all_that_was_kept(spark, tmp_path):
    index, rng, kept = KeyIndex(spark, str(tmp_path / "a"), bits=4), random.Random(1), set()
    for number in range(4):
        own = rng.sample(range(200), 40)
        wanted = digests(spark, own)
        found = {r.digest for r in index.candidates(wanted, number).collect()}
        again = {r.digest for r in wanted.collect()} & {hashlib.sha256(str(v).encode()).hexdigest() for v in kept}
        assert again <= found
        new = [v for v in own if v not in kept]
        index.add(digests(spark, new), number)
        # a batch that runs again doesn't see itself, and leaves the same
        assert {r.digest for r in index.candidates(digests(spark, new), number).collect()}.isdisjoint({hashlib.sha256(str(v).encode()).hexdigest() for v in new})
        index.add(digests(spark, new), number)
        kept |= set(own)
    assert spark.read.parquet(f"{tmp_path}/a/keys").count() == len(kept)
    more = index.regrown(str(tmp_path / "b"), bits=8)
    assert {r.digest for r in more.candidates(digests(spark, kept), 99).collect()} == {r.digest for r in digests(spark, kept).collect()}
    assert KeyIndex(spark, str(tmp_path / "c")).candidates(digests(spark, kept), 0).count() == 0


def test_bytes_that_a_batch_reads_stay_flat(spark, tmp_path):
    """Twenty batches of new keys and a few old ones: the last ones read about what the first ones did."""
    index, read = KeyIndex(spark, str(tmp_path), bits=11), []
    for number in range(20):
        own = [f"{number}-{i}" for i in range(6)] + [f"{number - 1}-{i}" for i in range(2)]
        found = index.candidates(digests(spark, own), number)
        read.append(bytes_of(found) if found.inputFiles() else 0)
        assert number == 0 or found.count() >= 2
        index.add(digests(spark, own[:6]), number)
    assert spark.read.parquet(f"{tmp_path}/keys").count() == 20 * 6
    assert sum(read[15:]) <= 2 * sum(read[1:6]) and max(read) <= 10_000


def test_states_that_end_by_themselves_with_late_events(spark, tmp_path):
    """Several batches, events late and out of order: the stream ends where a plain run over all events does, as of its watermark."""
    import datetime
    import os

    from curator.streaming import timers as T

    rng, hour = random.Random(3), 3_600_000
    moves, expiring = {("idle", "go"): "busy", ("busy", "stop"): "idle", ("busy", "break"): "broken", ("broken", "go"): "busy"}, {"busy": (5 * hour, "late"), "late": (9 * hour, "idle")}
    start = datetime.datetime(2024, 1, 1)
    events = [(u, i, start + datetime.timedelta(minutes=rng.randint(0, 60 * 24 * 6)), rng.choice(["go", "stop", "break", "nothing"])) for i in range(400) for u in (i % 9,)]
    events += [(1, 1000 + i, start + datetime.timedelta(hours=30), e) for i, e in enumerate(["go", "stop", "go"])]  # of one time
    events.sort(key=lambda e: e[2] + datetime.timedelta(hours=rng.randint(0, 40)))  # up to 40 hours late
    source = tmp_path / "in"
    schema = "user int, place bigint, ts timestamp_ntz, event string"
    for k in range(5):
        spark.createDataFrame(events[k * 81 : (k + 1) * 81], schema).coalesce(1).write.mode("append").parquet(str(source))
        newest = max(source.glob("*.parquet"), key=lambda f: f.stat().st_ctime_ns)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    T.run_machine(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "user", "event", "ts", "place", "idle", moves, expiring)
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 5
    got = {r.key: (r.state, r.since) for r in T.last_states(spark, str(tmp_path / "out")).collect()}
    ms = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    now = ms(max(e[2] for e in events)) - 48 * hour
    want = {}
    for user in range(9):
        state, since = "idle", None
        for at, _, event in sorted((ms(t), p, e) for u, p, t, e in events if u == user and ms(t) <= now):
            since = at if since is None else since
            while state in expiring and since + expiring[state][0] <= at:
                state, since = expiring[state][1], since + expiring[state][0]
            after = moves.get((state, event), state)
            state, since = (state, since) if after == state else (after, at)
        while state in expiring and since + expiring[state][0] <= now:
            state, since = expiring[state][1], since + expiring[state][0]
        want[user] = state
    assert {k: s for k, (s, _) in got.items()} == want and len(set(want.values())) > 1


def test_a_key_waits_for_one_timer_whatever_its_events():
    """A timer and a list entry for each event cost a call each: a key's batch takes one of both, and the next timer is set when that one ends."""
    import types

    import pandas as pd

    from curator.streaming.timers import Machine

    class State:
        def __init__(self):
            self.value, self.entries, self.timers = None, [], []

        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    machine, waiting, timers = State(), State(), []
    waiting.get, waiting.appendValue, waiting.put, waiting.clear = lambda: iter(waiting.entries), waiting.entries.append, lambda v: waiting.entries.__setitem__(slice(None), v), lambda: waiting.entries.clear()
    waiting.appendList = waiting.entries.extend
    handle = types.SimpleNamespace(getValueState=lambda *_: machine, getListState=lambda *_: waiting, registerTimer=timers.append)
    own = Machine("idle", {("idle", "go"): "busy", ("busy", "stop"): "idle"}, {"busy": (1000, "late")})
    own.init(handle)
    events = pd.DataFrame({"at": range(100, 5100, 10), "place": range(500), "event": ["go", "stop"] * 249 + ["go", "nothing"]})
    assert list(own.handleInputRows((1,), iter([events[250:], events[:250]]), None)) == []
    assert timers == [100] and len(waiting.entries) == 2
    run = lambda now: [r for df in own.handleExpiredTimer((1,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None) for r in df.itertuples(index=False, name=None)]
    assert run(205) == [(1, "busy", 200, 205)]  # of 11 events, the last says go
    assert 210 in timers and sum(len(at) for at, _, _ in waiting.entries) == 489
    assert run(5090) == [(1, "busy", 5080, 5090)] and waiting.entries == [] and timers[-1] == 6080
    assert run(6080) == [(1, "late", 6080, 6080)]
