"""Slots that runs own, as a stream: what a temporary key holds is handed to the known key as soon as that is learnt.

Two stages of state. A run's own key keeps its best run and the key it stands for; once that is known, what is held
goes over to it and the own slot is released. A slot keeps the best run of all that came. The best is a maximum, so the
outcome depends neither on batches nor on whether runs or the known key come first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.tables import latest_by
from millrace.streaming.tracker import ROCKS

_HELD = "slot string, rank long, place long, owner long, status string"
_CHANGES = "slot string, version long, owner long, status string"
#: Ranks below all runs': nothing held, and a slot that was given up.
NOTHING, RELEASED = -1, -2
_HELD_ROW = Row("slot", "rank", "place", "owner", "status")
_CHANGE = Row("slot", "version", "owner", "status")


class _HandOver(StatefulProcessor):
    """One own key: (rank, place, run, status) of its best run, and the known key once there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank long, place long, owner long, status string")
        self.known = handle.getValueState("known", "slot string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, known = self.best.get() or (NOTHING, 0, None, None), (self.known.get() or (None,))[0]
        best, learnt = tuple(before), None
        for row in rows:
            if row.rank >= 0 and (row.rank, row.place) > best[:2]:
                best = (row.rank, row.place, row.run, row.status)
            if known is None and learnt is None:
                learnt = row.target
        if learnt is not None and learnt != key[0]:
            self.known.update((learnt,))
            yield _HELD_ROW(key[0], RELEASED, 0, None, None)
        if best[0] >= 0 and (best != tuple(before) or learnt is not None):
            self.best.update(best)
            yield _HELD_ROW(known or learnt or key[0], *best)


class _Slot(StatefulProcessor):
    """One slot: its best run; a released one has no owner for good."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank long, place long, owner long, status string, version long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        *before, version = self.best.get() or (NOTHING, 0, None, None, 0)
        best = tuple(before)
        for row in rows:
            if row.rank == RELEASED:
                best = (RELEASED, 0, None, None)
            elif best[0] != RELEASED and (row.rank, row.place) > best[:2]:
                best = (row.rank, row.place, row.owner, row.status)
        if best != tuple(before):
            self.best.update((*best, version + 1))
            yield _CHANGE(key[0], version + 1, best[2], best[3])


def slot_changes(runs: DataFrame, key: str, run: str, seq: str, status: str, target: Column) -> DataFrame:
    """(slot, version, owner, status) whenever a slot's owner changes; a released slot has none.

    A complete owner is kept, the earliest first; else the newest running one takes the slot; else the newest. ``target``
    is the known key of a run, null while it is not known; rows with a null ``run`` only tell it. Known keys are not
    temporary ones themselves.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rank = F.when(F.col(run).isNull(), NOTHING).when(F.col(status) == "complete", 2).when(F.col(status) == "running", 1).otherwise(0)
    place = F.when(F.col(status) == "complete", -F.col(seq)).otherwise(F.col(seq))
    rows = runs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), rank.cast("long").alias("rank"), place.cast("long").alias("place"), F.col(run).cast("long").alias("run"), F.col(status).alias("status"), target.cast("string").alias("target"))
    held = rows.groupBy("key").transformWithState(_HandOver(), _HELD, "Append", "None")
    return held.groupBy("slot").transformWithState(_Slot(), _CHANGES, "Append", "None")


def current_slots(changes: DataFrame) -> DataFrame:
    """(slot, owner, status) of the slots that have an owner now."""
    return latest_by(changes, ["slot"], F.col("version")).where("owner is not null").select("slot", "owner", "status")
