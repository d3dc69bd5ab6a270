"""Windows anchored on the last accepted event: admission control, suppression, throttles.

A window starts at a key's first event, holds events up to ``gap`` after it, and the next event starts the next.
The anchor depends on all earlier anchors, so neither ``window`` (aligned to the epoch), ``session_window``
(extended by every event) nor ``lag`` gives it. Rows are dealt by key and block of time and sorted, and one pass
carries the anchor; memory stays that of a batch.

A key with more than ``block`` events is cut into blocks of time that many tasks work on. What a block does is a step
function of the anchor that comes in: where that anchor's window ends decides which of the block's events starts the
next, and from there on all is fixed. Blocks' functions are composed in groups, groups' functions in groups of those,
and so on up to one per key; going down again gives every block its anchor, and then each is folded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import written

#: Events of a key in one block, about; blocks in one group.
BLOCK, GROUP = 1_000_000, 32
_NONE = -(1 << 62)
_STEPS = "key long, block long, n long, open boolean, bounds array<long>, times array<long>, places array<long>"
_ENTRY = "key long, block long, anchor long, place long, begin long"


def _events(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("id"), micros.alias("at"))
    return rows.where("key is not null and at is not null")


def _sorted(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    return _events(df, key, ts, order).repartition("key").sortWithinPartitions("key", "at", "id")


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    n = len(keys[0])
    edges = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [n]])):
        if b > a:
            yield int(a), int(b)


class _Steps:
    """A block's step function: an anchor whose window ends before ``bounds[i]``, not before the one before, leaves as ``times[i]``.

    ``places`` are the anchors' places among the key's events. Beyond the last bound an anchor leaves as it came, which
    happens only where the block is ``open``, all of it within one gap.
    """

    def __init__(self, gap: int, side: str, n: int, is_open: bool, bounds: np.ndarray, times: np.ndarray, places: np.ndarray):
        self.gap, self.side, self.n, self.open = gap, side, n, is_open
        last = np.append(times[1:] != times[:-1], True) if len(times) else np.zeros(0, bool)
        self.bounds, self.times, self.places = bounds[last], times[last], places[last]

    @classmethod
    def of(cls, at: np.ndarray, gap: int, side: str) -> _Steps:
        n = len(at)
        most = int(np.searchsorted(at, at[0] + gap, side=side)) + 1  # no anchor before the block reaches beyond its first gap
        following = np.searchsorted(at, at + gap, side=side)
        following = np.maximum(following, np.arange(1, n + 1))
        leaves = np.arange(n)
        # going backwards an event leaves as its follower does; doubling does it for all at once
        hop = np.append(following, n)
        while True:
            ahead = hop[hop]
            moved = hop[:n] < n
            if not moved.any():
                break
            leaves = np.where(moved, leaves[np.minimum(hop[:n], n - 1)], leaves)
            hop = ahead
        leaves = np.searchsorted(at, at[leaves], side="left")  # of events at one time the first is the anchor
        first = slice(0, min(most, n))
        return cls(gap, side, n, most > n, at[first], at[leaves[first]], leaves[first].astype(np.int64))

    def __call__(self, times: np.ndarray, places: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Where anchors go that come in; the block's own places begin at ``shift``."""
        at = np.searchsorted(self.bounds, times + self.gap, side=self.side)
        inside = at < len(self.bounds)
        at = np.where(inside, at, 0)
        if not len(self.bounds):
            return times, places
        return np.where(inside, self.times[at], times), np.where(inside, self.places[at] + shift, places)

    def then(self, after: _Steps) -> _Steps:
        times, places = after(self.times, self.places, self.n)
        bounds, is_open = self.bounds, False
        if self.open:  # what passes through this block enters the next as it came
            bounds, times, places = (np.concatenate(x) for x in ((bounds, after.bounds), (times, after.times), (places, after.places + self.n)))
            is_open = after.open
        return _Steps(self.gap, self.side, self.n + after.n, is_open, bounds, times, places)

    @classmethod
    def read(cls, table: pa.Table, gap: int, side: str) -> list[_Steps]:
        rows = table.sort_by("block").to_pylist()
        return [cls(gap, side, r["n"], r["open"], *(np.asarray(r[c], dtype=np.int64) for c in ("bounds", "times", "places"))) for r in rows]

    def row(self, key: int, block: int) -> dict:
        return {"key": key, "block": block, "n": self.n, "open": self.open, "bounds": self.bounds, "times": self.times, "places": self.places}


def _table(rows: list[dict], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[name] for r in rows], kind) for name, kind in schema})


_LONGS = pa.list_(pa.int64())
_STEPS_ARROW = [("key", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("bounds", _LONGS), ("times", _LONGS), ("places", _LONGS)]
_ENTRY_ARROW = [(name, pa.int64()) for name in ("key", "block", "anchor", "place", "begin")]


def _block_steps(rows: DataFrame, gap: int, side: str) -> DataFrame:
    """The step function of every block of the given events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for batch in batches:
            key, block, at = (batch.column(c).to_numpy() for c in ("key", "block", "at"))
            for a, b in _runs(key, block):
                if now is not None and now != (int(key[a]), int(block[a])):
                    yield from _table([_Steps.of(np.concatenate(held), gap, side).row(*now)], _STEPS_ARROW).to_batches()
                    held = []
                now = int(key[a]), int(block[a])
                held.append(at[a:b].copy())
        if now is not None:
            yield from _table([_Steps.of(np.concatenate(held), gap, side).row(*now)], _STEPS_ARROW).to_batches()

    return rows.mapInArrow(run, _STEPS)


def _entries(steps: DataFrame, gap: int, side: str, group: int) -> DataFrame:
    """(key, block, anchor, place, begin): what comes into every block, and where its events begin among the key's."""
    most = steps.agg(F.max("block")).first()[0] or 0

    def walk(table: pa.Table, anchor: int, place: int, begin: int) -> pa.Table:
        out, numbers = [], sorted(table.column("block").to_pylist())
        key = table.column("key")[0].as_py()
        for number, step in zip(numbers, _Steps.read(table, gap, side)):
            out.append({"key": key, "block": number, "anchor": anchor, "place": place, "begin": begin})
            times, places = step(np.array([anchor]), np.array([place]), begin)
            anchor, place, begin = int(times[0]), int(places[0]), begin + step.n
        return _table(out, _ENTRY_ARROW)

    if most < group:
        return steps.groupBy("key").applyInArrow(lambda t: walk(t, _NONE, 0, 0), _ENTRY)

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        first, *rest = _Steps.read(table, gap, side)
        for step in rest:
            first = first.then(step)
        return _table([first.row(key[0].as_py(), key[1].as_py())], _STEPS_ARROW)

    above = F.floor(F.col("block") / group).alias("above")
    upper = written(steps.groupBy("key", above).applyInArrow(compose, _STEPS), "anchor-steps")
    into = _entries(upper, gap, side, group).select("key", F.col("block").alias("above"), F.col("anchor").alias("a"), F.col("place").alias("p"), F.col("begin").alias("g"))
    held = steps.withColumn("above", above).join(into, ["key", "above"])
    return held.groupBy("key", "above").applyInArrow(lambda t: walk(t, t.column("a")[0].as_py(), t.column("p")[0].as_py(), t.column("g")[0].as_py()), _ENTRY)


def _blocks(events: DataFrame, gap: int, side: str, block: int, group: int) -> DataFrame:
    """The events with their block and what comes into it; keys of up to ``block`` events are one block."""
    large = events.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", "n")
    large = written(large, "anchor-keys")
    alone = {"block": F.lit(0).cast("long"), "anchor": F.lit(_NONE).cast("long"), "place": F.lit(0).cast("long"), "begin": F.lit(0).cast("long")}
    if large.isEmpty():
        return events.select("*", *[v.alias(k) for k, v in alone.items()])
    # quantiles of a large key's times: one cut for each ``block`` events, so all cuts together are few whatever the input is
    most = -(-large.agg(F.max("n")).first()[0] // block)
    shares = [i / most for i in range(1, most)]
    hot = events.join(F.broadcast(large), "key")
    cuts = hot.groupBy("key", "n").agg(F.percentile_approx("at", shares, max(10_000, 20 * most)).alias("c"))
    wanted = F.ceil(F.col("n") / block)
    every = F.filter("c", lambda x, i: F.floor((i + 1) * wanted / most) > F.floor(i * wanted / most))
    cuts = written(cuts.select("key", F.array_sort(F.array_distinct(every)).alias("cuts")), "anchor-cuts")
    number = F.size(F.filter("cuts", lambda x: x <= F.col("at"))).cast("long")
    dealt = events.join(F.broadcast(cuts), "key", "left").withColumn("block", F.when(F.col("cuts").isNull(), 0).otherwise(number).cast("long"))
    parts = dealt.where("cuts is not null").select("key", "block", "at").repartition("key", "block").sortWithinPartitions("key", "block", "at")
    steps = written(_block_steps(parts, gap, side), "anchor-steps")
    entries = written(_entries(steps, gap, side, group), "anchor-entries")
    joined = dealt.drop("cuts").join(F.broadcast(entries), ["key", "block"], "left")
    return joined.select("key", "id", "at", "block", *[F.coalesce(k, v).alias(k) for k, v in alone.items() if k != "block"])


def anchored_windows(df: DataFrame, key: str, ts: str, order: str, gap_us: int, strict: bool, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Per event: key, id, at (microseconds), window_start, and its rank in the window, from 1.

    ``strict``: an event exactly ``gap`` after the anchor is still inside; otherwise it starts the next window.
    Ties in time go by ``order``; events without key or time are left out. Events of a key at one and the same
    microsecond share a block, however many they are.
    """
    side = "right" if strict else "left"
    rows = _blocks(_events(df, key, ts, order), gap_us, side, block, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, seen = None, 0, 0
        for batch in batches:
            keys, blocks, at = (batch.column(c).to_numpy() for c in ("key", "block", "at"))
            coming, places, begins = (batch.column(c).to_numpy() for c in ("anchor", "place", "begin"))
            start, rank = np.empty_like(at), np.empty_like(at)
            for a, b in _runs(keys, blocks):
                i = a
                here = (int(keys[a]), int(blocks[a]))
                if here != last:
                    anchor, seen = int(coming[a]), int(begins[a] - places[a])
                if anchor != _NONE:
                    i = a + int(np.searchsorted(at[a:b], anchor + gap_us, side=side))
                    start[a:i], rank[a:i] = anchor, np.arange(seen + 1, seen + 1 + i - a)
                    seen += i - a
                while i < b:
                    anchor = int(at[i])
                    j = max(i + 1, i + int(np.searchsorted(at[i:b], anchor + gap_us, side=side)))
                    start[i:j], rank[i:j] = anchor, np.arange(1, j - i + 1)
                    i, seen = j, j - i
                last = here
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "at")), pa.array(start), pa.array(rank)], names=["key", "id", "at", "window_start", "rank"])

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "at", "id")
    return dealt.mapInArrow(run, "key long, id long, at long, window_start long, rank long")


def admit(df: DataFrame, key: str, ts: str, order: str, most: int = 20, minutes: int = 60) -> DataFrame:
    """Fixed windows from the first request: up to ``most`` are allowed, and the first of a window always."""
    windows = anchored_windows(df, key, ts, order, minutes * 60_000_000, strict=True)
    return windows.withColumn("allowed", (F.col("rank") <= most) | (F.col("rank") == 1))


def suppress_repeats(df: DataFrame, key: str, ts: str, order: str, gap_us: int) -> DataFrame:
    """Events at least ``gap`` after the last accepted one; rejected ones extend nothing."""
    return anchored_windows(df, key, ts, order, gap_us, strict=False).withColumn("accepted", F.col("rank") == 1)


def throttle_leading(df: DataFrame, key: str, ts: str, order: str, gap_us: int) -> DataFrame:
    """Leading events of each gap, and the key's last event as a flush."""
    windows = suppress_repeats(df, key, ts, order, gap_us)
    last = windows.groupBy("key").agg(F.max(F.struct("at", "id")).alias("last"))
    emitted: Column = F.col("accepted") | (F.struct("at", "id") == F.col("last"))
    return windows.join(last, "key").withColumn("emitted", emitted).drop("last")


def throttle_trailing(df: DataFrame, key: str, ts: str, order: str, gap_us: int) -> DataFrame:
    """Emissions (key, id, emitted_at, trailing): leading events at once, the newest suppressed one when the gap ends.

    A trailing emission anchors the next gap; one due exactly when an event comes goes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, pending = None, 0, None
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            keys, ids, at = (batch.column(c).to_numpy() for c in ("key", "id", "at"))
            for a, b in _runs(keys):
                i = a
                if keys[a] != key:
                    if pending is not None:
                        out.append((key, pending, last + gap_us, True))
                    key, last, pending = int(keys[a]), None, None
                while i < b:
                    if last is not None:
                        j = i + int(np.searchsorted(at[i:b], last + gap_us, side="left"))
                        if j > i:  # suppressed until the gap ends
                            pending, i = int(ids[j - 1]), j
                            if j == b:
                                break
                    if pending is not None:
                        last += gap_us
                        out.append((key, pending, last, True))
                        pending = None
                        continue
                    last = int(at[i])
                    out.append((key, int(ids[i]), last, False))
                    i += 1
            yield _emissions(out)
        if pending is not None:
            yield _emissions([(key, pending, last + gap_us, True)])

    return _sorted(df, key, ts, order).mapInArrow(run, "key long, id long, emitted_at long, trailing boolean")


def _emissions(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "id", "emitted_at", "trailing"])
