"""Runs of an analysis followed as a stream: single flight with restarts, a hard timeout, and eviction of all that a key holds.

A key holds three states: its run, the aliases that point to it, and the time of its last accepted save. Deadlines are
timers, so they pass without events. Within a batch deadlines that lie before an event are met before it; what comes
out does not depend on how events fall into batches, where each key's events come in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, id long, what string, at long, aliases long, anchored boolean"
_OUT = Row("key", "id", "what", "at", "aliases", "anchored")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Outcomes after which a request starts anew.
FAILED = ("error", "not_found")


class RunTracker(StatefulProcessor):
    """Rules of one key, in milliseconds.

    A ``run`` starts where there is none or the last one failed, and joins one that is running or complete. ``complete``,
    ``error`` and ``not_found`` end a running run. A run still running ``timeout`` after its start turns to an error.
    The first end since the last clean-up sets one for ``idle`` later: it drops the run unless it is running again,
    and aliases and the save's anchor in any case. A ``save`` is accepted unless an accepted one lies less than ``repeat`` before.
    """

    def __init__(self, timeout: int, idle: int, repeat: int, event_time: bool, ttl: int | None):
        self.timeout, self.idle, self.repeat, self.event_time, self.ttl = timeout, idle, repeat, event_time, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, started long, clean_at long", self.ttl)
        self.aliases = handle.getMapState("aliases", "alias string", "at long", self.ttl)
        self.saved = handle.getValueState("saved", "at long", self.ttl)

    def close(self) -> None:
        pass

    def _read(self) -> None:
        run, saved = self.run.get(), self.saved.get()
        self.status, self.started, self.clean_at = run or (None, None, None)
        self.anchor = saved[0] if saved else None
        self.held = (run and tuple(run), self.anchor, self._due())
        self.fresh: dict[str, int] = {}

    def _write(self) -> None:
        """What has changed goes to the state; a key has one timer, that of its next deadline."""
        run, anchor, due = self.held
        now = None if self.status is None and self.clean_at is None else (self.status, self.started, self.clean_at)
        # a state with a time to live is written again, for that renews it
        if now is None and run is not None:
            self.run.clear()
        elif now is not None and (now != run or self.ttl):
            self.run.update(now)
        if self.anchor is None and anchor is not None:
            self.saved.clear()
        elif self.anchor is not None and (self.anchor != anchor or self.ttl):
            self.saved.update((self.anchor,))
        self._keep_aliases()
        then = self._due()
        if (then and then[0]) != (due and due[0]):
            if due is not None:
                self.handle.deleteTimer(due[0])
            if then is not None:
                self.handle.registerTimer(then[0])

    def _keep_aliases(self) -> None:
        for alias, at in self.fresh.items():
            self.aliases.updateValue((alias,), (at,))
        self.fresh = {}

    def _drop_aliases(self) -> int:
        """Their number; those told since the state was read are not in it yet."""
        if not self.aliases.exists():
            held, self.fresh = len(self.fresh), {}
            return held
        self._keep_aliases()
        held = sum(1 for _ in self.aliases.keys())
        self.aliases.clear()
        return held

    def _due(self) -> tuple[int, str] | None:
        """The next deadline; a timeout goes before a clean-up at the same time."""
        deadlines = [(self.started + self.timeout, "timeout")] if self.status == "running" else []
        if self.clean_at is not None:
            deadlines.append((self.clean_at, "~clean"))
        return min(deadlines, default=None)

    def _end(self, status: str, at: int) -> None:
        self.status = status
        if self.clean_at is None:
            self.clean_at = at + self.idle

    def _advance(self, until: int, out: list[tuple]) -> None:
        while (due := self._due()) is not None and due[0] <= until:
            at, what = due
            if what == "timeout":
                self._end("error", at)
                out.append((None, "timeout", at, 0, False))
                continue
            held, anchored, self.clean_at = self._drop_aliases(), self.anchor is not None, None
            self.anchor = None
            kept = self.status == "running"
            if not kept:
                self.status = self.started = None
            out.append((None, "kept" if kept else "evicted", at, held, anchored))

    def _event(self, id_: int, what: str, at: int, alias: str | None) -> tuple:
        if what == "run":
            starts = self.status is None or self.status in FAILED
            if starts:
                self.status, self.started = "running", at
            return id_, "started" if starts else "joined", at, 0, False
        if what == "save":
            accepted = self.anchor is None or at - self.anchor >= self.repeat
            self.anchor = at if accepted else self.anchor
            return id_, "saved" if accepted else "suppressed", at, 0, False
        if what == "alias":
            self.fresh[alias] = at
            return id_, "aliased", at, 0, False
        ends = self.status == "running"
        if ends:
            self._end(what, at)
        return id_, what if ends else "ignored", at, 0, False

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._read()
        for ms, id_, what, alias in sorted(((row.ms, row.id, row.what, row.alias) for row in rows), key=lambda e: e[:2]):
            out: list[tuple] = []
            if self.event_time:
                self._advance(ms, out)
            out.append(self._event(id_, what, ms, alias))
            for made in out:
                yield _OUT(key[0], *made)
        self._write()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._read()
        out: list[tuple] = []
        self._advance(timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs(), out)
        self._write()
        for made in out:
            yield _OUT(key[0], *made)


def track_runs(
    events: DataFrame, key: str, ts: str, order: str, what: str, alias: str, timeout_ms: int = 120_000, idle_ms: int = 300_000, repeat_ms: int = 60_000,
    event_time: bool = True, delay: str = "0 seconds", ttl_ms: int | None = None,
) -> DataFrame:
    """(key, id, what, at, aliases, anchored): what became of each event, and timeouts and clean-ups (id null) when they are due.

    ``aliases`` and ``anchored`` say what a clean-up dropped. With ``event_time`` deadlines follow the watermark, else
    the clock, and then they are met with no events coming; ``ttl_ms`` (clock only) lets the states of a silent key expire as well.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withWatermark(ts, delay) if event_time else events
    named = rows.select(F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("ms"), F.col(order).cast("long").alias("id"), F.col(what).alias("what"), F.col(alias).cast("string").alias("alias"))
    processor = RunTracker(timeout_ms, idle_ms, repeat_ms, event_time, None if event_time else ttl_ms)
    return named.groupBy("key").transformWithState(processor, OUT, "Append", "EventTime" if event_time else "ProcessingTime")
