"""Streams on files against their batch forms."""

import datetime as dt
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.plans import runs
from millrace.operators import anchored
from millrace.operators import runs as U
from millrace.streaming.stateful import admission, batch_sink, drain, idle_states, lines_stream, single_flight, tee
from millrace.streaming.slots import _HandOver, _Slot, current_slots, slot_changes
from millrace.streaming.tracker import RunTracker, track_runs


def write(df, path, n):
    df.coalesce(1).write.parquet(f"{path}/{n}")
    return f"file://{path}/*"


def test_admission_stream_equals_batch(spark, sf):
    batch = {(r.key, r.id): r.allowed for r in anchored.admit(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id", 2, 1440).collect()}
    stream = {(r.key, r.id): r.allowed for r in runs.w1_admission_stream(spark, sf).collect()}
    assert stream == batch


def test_admission_over_several_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).collect()[0][0]
    write(events.where(F.col("event_id") <= middle), f"file://{tmp_path}", "a")
    path = write(events.where(F.col("event_id") > middle), f"file://{tmp_path}", "b").replace("file://file://", "file://")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.key, r.id): r.allowed for r in drain(admission(source, "user_id", "ts", "event_id", 2, 1440), "admission").collect()}
    want = {(r.key, r.id): r.allowed for r in anchored.admit(events, "user_id", "ts", "event_id", 2, 1440).collect()}
    assert got == want


def test_single_flight_and_idle_states(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "running", t), ("a", "complete", t + dt.timedelta(seconds=30)), ("b", "running", t)]
    path = write(spark.createDataFrame(rows, "k string, status string, ts timestamp"), f"file://{tmp_path}", "a").replace("file://file://", "file://")
    source = spark.readStream.schema("k string, status string, ts timestamp").parquet(path)
    assert sorted(r.k for r in drain(single_flight(source, "k", "ts"), "flight").collect()) == ["a", "b"]
    first = drain(idle_states(source, "k", "ts", "status"), "idle").collect()
    assert {(r.key, r.status, r.evicted) for r in first} == {("a", "complete", False), ("b", "running", False)}


def test_a_repeated_batch_stands_once_in_every_sink(spark, tmp_path):
    path = write(spark.range(100), f"file://{tmp_path}/in", "a").replace("file://file://", "file://")
    first, second, tries = f"file://{tmp_path}/first", batch_sink(f"file://{tmp_path}/second", F.col("id") < 10), []

    def fails_once(batch, number):
        tries.append(number)
        if len(tries) == 1:
            raise OSError("sink is away")
        second(batch, number)

    for _ in range(2):
        query = tee(spark.readStream.schema("id long").parquet(path), batch_sink(first), fails_once, checkpoint=f"file://{tmp_path}/check")
        try:
            query.awaitTermination()
        except Exception as error:
            assert "sink is away" in str(error)
    assert tries == [0, 0] and spark.read.parquet(first).count() == 100 and spark.read.parquet(f"file://{tmp_path}/second").count() == 10


LIFE = "k string, id long, ts timestamp, what string, alias string"


def lifecycle(spark, tmp_path, *batches):
    """A stream of one micro-batch for each list of (key, id, seconds, what, alias)."""
    t = dt.datetime(2024, 1, 1)
    for n, rows in enumerate(batches):
        write(spark.createDataFrame([(k, i, t + dt.timedelta(seconds=s), w, a) for k, i, s, w, a in rows], LIFE), f"file://{tmp_path}", str(n))
        time.sleep(1.1)  # files are read in the order of their times, which are seconds
    return spark.readStream.schema(LIFE).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/*")


def tracked(stream, name):
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = drain(track_runs(stream, "k", "ts", "id", "what", "alias"), name).collect()
    return sorted(((r.key, (r.at - zero) / 1000, r.what, r.id, r.aliases, r.anchored) for r in rows), key=str)


def test_tracker_restarts_times_out_and_evicts_all_states(spark, tmp_path):
    first = [("a", 1, 0, "run", None), ("a", 2, 5, "run", None), ("a", 3, 10, "error", None), ("a", 4, 11, "run", None), ("a", 5, 20, "alias", "t1"), ("a", 6, 21, "save", None), ("a", 7, 30, "save", None), ("b", 8, 0, "run", None)]
    second = [("a", 9, 40, "complete", None), ("a", 10, 50, "run", None), ("c", 11, 200, "run", None)]
    third = [("c", 12, 250, "not_found", None), ("c", 13, 260, "run", None), ("d", 14, 700, "save", None)]
    want = [
        ("a", 0.0, "started", 1, 0, False), ("a", 5.0, "joined", 2, 0, False), ("a", 10.0, "error", 3, 0, False), ("a", 11.0, "started", 4, 0, False), ("a", 20.0, "aliased", 5, 0, False), ("a", 21.0, "saved", 6, 0, False),
        ("a", 30.0, "suppressed", 7, 0, False), ("a", 40.0, "complete", 9, 0, False), ("a", 50.0, "joined", 10, 0, False), ("a", 310.0, "evicted", None, 1, True), ("b", 0.0, "started", 8, 0, False), ("b", 120.0, "timeout", None, 0, False),
        ("b", 420.0, "evicted", None, 0, False), ("c", 200.0, "started", 11, 0, False), ("c", 250.0, "not_found", 12, 0, False), ("c", 260.0, "started", 13, 0, False), ("c", 380.0, "timeout", None, 0, False), ("c", 550.0, "evicted", None, 0, False),
        ("d", 700.0, "saved", 14, 0, False),
    ]
    split = tracked(lifecycle(spark, tmp_path / "split", first, second, third), "tracker-split")
    whole = tracked(lifecycle(spark, tmp_path / "whole", first + second + third), "tracker-whole")
    assert split == whole == sorted(want, key=str)


def test_running_keys_outlive_the_clean_up(spark, tmp_path):
    rows = [("a", 1, 0, "run", None), ("a", 2, 1, "error", None), ("a", 3, 2, "alias", "x"), ("a", 4, 250, "run", None), ("a", 5, 310, "complete", None), ("b", 6, 320, "run", None)]
    got = [r for r in tracked(lifecycle(spark, tmp_path, rows), "tracker-kept") if r[0] == "a"]
    assert ("a", 301.0, "kept", None, 1, False) in got and ("a", 310.0, "complete", 5, 0, False) in got and not any(r[2] == "evicted" for r in got)


def test_a_stuck_run_times_out_by_the_clock(spark, tmp_path):
    """No event comes after the first: the timer fires all the same."""
    stream = lifecycle(spark, tmp_path / "in", [("a", 1, 0, "run", None)]).withColumn("ts", F.current_timestamp())
    query = track_runs(stream, "k", "ts", "id", "what", "alias", timeout_ms=1_000, idle_ms=1_500, event_time=False, ttl_ms=600_000).writeStream.format("memory").queryName("stuck").option("checkpointLocation", f"file://{tmp_path}/check").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        seen = []
        while time.time() < until and "evicted" not in seen:
            time.sleep(0.5)
            seen = [r.what for r in spark.table("stuck").collect()]
        assert sorted(seen) == ["evicted", "started", "timeout"]
    finally:
        query.stop()


def test_slots_are_handed_over_between_batches(spark, sf, tmp_path):
    """The known key comes before, with or after the runs; the owners are those of the batch form, and temporary slots are gone."""
    kind = "k string, run long, status string, target string"
    batches = [
        [("t1", 1, "running", None), ("t2", 2, "complete", None), ("k1", 3, "running", None), ("t3", None, None, "k2")],
        [("t1", None, None, "k1"), ("t2", 4, "error", None), ("t3", 5, "running", None), ("k3", 6, "error", None)],
        [("t2", None, None, "k1"), ("k1", 7, "running", None), ("t1", 8, "complete", None), ("k3", 9, "error", None)],
    ]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, kind), f"file://{tmp_path}", str(n))
        time.sleep(1.1)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/*")
    changes = drain(slot_changes(stream, "k", "run", "run", "status", F.col("target")), "slots-test")
    got = {(r.slot, r.owner, r.status) for r in current_slots(changes).collect()}
    every = spark.createDataFrame([r for rows in batches for r in rows], kind)
    aliases = every.where("target is not null").select(F.col("k").alias("alias"), "target")
    batch = U.slot_owner(every.where("run is not null"), aliases, "k", "run", "run", "status")
    assert got == {tuple(r) for r in batch.collect()} == {("k1", 2, "complete"), ("k2", 5, "running"), ("k3", 9, "error")}
    owners = [r.owner for r in changes.where("slot = 'k1'").orderBy("version").collect()]
    assert owners[0] == 3 and owners[-1] == 2 and len(owners) > 1


def test_open_lines_are_carried_between_batches(spark, tmp_path):
    batches = [[("a", 0, "one\ntw"), ("b", 0, "x")], [("a", 1, "o"), ("a", 2, "\n\nfour"), ("b", 1, "y\n")], [("a", 3, " more"), ("a", 4, None), ("b", 2, None)]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "k string, s long, t string"), f"file://{tmp_path}", str(n))
        time.sleep(1.1)
    stream = spark.readStream.schema("k string, s long, t string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/*")
    rows = drain(lines_stream(stream, "k", "s", "t"), "lines").collect()
    assert sorted((r.key, r.seq, r.line) for r in rows) == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, "four more"), ("b", 0, "xy"), ("b", 1, "")]


class Counted:
    """States of one key in memory, and how often they are asked."""

    def __init__(self):
        self.calls, self.values, self.maps = 0, {}, {}

    def _state(self, name):
        handle = self

        class State:
            def exists(self):
                handle.calls += 1
                return bool(handle.values.get(name) or handle.maps.get(name))

            def get(self):
                handle.calls += 1
                return handle.values.get(name)

            def update(self, value):
                handle.calls += 1
                handle.values[name] = value

            def updateValue(self, key, value):
                handle.calls += 1
                handle.maps.setdefault(name, {})[key] = value

            def keys(self):
                handle.calls += 1
                return list(handle.maps.get(name, {}))

            def clear(self):
                handle.calls += 1
                handle.values.pop(name, None), handle.maps.pop(name, None)

        return State()

    def getValueState(self, name, *kinds):
        return self._state(name)

    getMapState = getValueState

    def listTimers(self):
        self.calls += 1
        return list(self.maps.get("timers", ()))

    def registerTimer(self, at):
        self.calls += 1
        self.maps.setdefault("timers", {})[at] = True

    def deleteTimer(self, at):
        self.calls += 1
        self.maps.get("timers", {}).pop(at, None)


def test_a_keys_states_are_asked_once_a_batch_not_once_an_event():
    event, handle = Row("ms", "id", "what", "alias"), Counted()
    tracker = RunTracker(1_000, 5_000, 100, True, None)
    tracker.init(handle)
    kinds = ["run", "alias", "save", "complete"]
    first = [event(100 * i, i, kinds[i % 4], f"t{i}") for i in range(2_000)]
    out = list(tracker.handleInputRows(("a",), iter(first), None))
    assert [r.id for r in out if r.id is not None] == list(range(2_000)) and any(r.what == "evicted" and r.aliases > 1 for r in out)
    assert handle.calls < 60  # the aliases since the last clean-up, run, anchor and one timer
    left, before = len(handle.maps["aliases"]), handle.calls
    (timer,) = handle.maps["timers"]
    later = list(tracker.handleInputRows(("a",), iter([event(timer - 1, 2_000, "alias", "new"), event(timer + 1, 2_001, "save", None)]), None))
    assert [(r.what, r.aliases) for r in later if r.what in ("evicted", "kept")] == [("evicted", left + 1)] and handle.calls - before < 20
    assert "aliases" not in handle.maps and not handle.maps["timers"]


def test_slots_take_rows_and_ask_their_states_once():
    run, held, handle = Row("rank", "place", "run", "status", "target"), Row("rank", "place", "owner", "status"), Counted()
    over, slot = _HandOver(), _Slot()
    over.init(handle)
    rows = [run(1, i, i, "running", "k" if i == 50 else None) for i in range(1_000)]
    assert [tuple(r) for r in over.handleInputRows(("t",), iter(rows), None)] == [("t", -2, 0, None, None), ("k", 1, 999, 999, "running")]
    assert handle.calls <= 4
    slot.init(handle := Counted())
    assert [tuple(r) for r in slot.handleInputRows(("k",), iter([held(1, i, i, "running") for i in range(1_000)]), None)] == [("k", 1, 999, "running")]
    assert not list(slot.handleInputRows(("k",), iter([held(1, 5, 5, "running")]), None)) and handle.calls <= 4
