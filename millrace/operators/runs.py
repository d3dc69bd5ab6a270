"""Runs of an analysis by key: single flight, re-keying, cut-off, eviction and status, replayed from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookup import resolve_alias
from millrace.operators.tables import latest_by

TERMINAL = ("complete", "error", "not_found")


def single_flight(requests: DataFrame, key: str, order: list[Column], status: Column) -> DataFrame:
    """``started``: whether a request starts a run or joins the one there is.

    A running or complete run is joined; one that failed or found nothing is started again. So a request starts one
    exactly if every run before it failed.
    """
    alive = F.when(status.isin("running", "complete"), 1).otherwise(0)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("started", F.coalesce(F.sum(alive).over(before), F.lit(0)) == 0)


def slot_owner(runs: DataFrame, aliases: DataFrame, key: str, run: str, seq: str, status: str) -> DataFrame:
    """(canonical, owner, status) once temporary keys have become known ones.

    A complete owner is reused, the earliest first; else the newest running one has taken the slot; else the newest.
    """
    known = resolve_alias(runs, aliases, key)
    rank = F.when(F.col(status) == "complete", 2).when(F.col(status) == "running", 1).otherwise(0)
    when = F.when(F.col(status) == "complete", -F.col(seq)).otherwise(F.col(seq))
    best = known.groupBy("canonical").agg(F.max(F.struct(rank.alias("r"), when.alias("w"), F.col(run).alias("owner"), F.col(status).alias("status"))).alias("x"))
    return best.select("canonical", "x.owner", "x.status")


def cut_off(cached: Column, parsed_ingredients: Column, least: int = 10) -> Column:
    """A cached result stops a run only while fewer than ``least`` ingredients have been parsed."""
    return cached & (parsed_ingredients < least)


def evict_idle(states: DataFrame, now: Column, minutes: int = 5, last: str = "last_at", status: str = "status") -> DataFrame:
    """States that stay: running ones, and those touched within ``minutes``."""
    return states.where((F.col(status) == "running") | (F.col(last) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def latest_status(events: DataFrame, key: str, order: list[Column], status: str) -> DataFrame:
    """Status of every key by its latest event, and whether it is terminal; events without a status (aborts) are silent."""
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = events.where(F.col(status).isNotNull()).select(key, status, *named)
    last = latest_by(rows, [key], *[F.col(f"o{i}") for i in range(len(order))])
    return last.select(key, status, F.col(status).isin(*TERMINAL).alias("terminal"))
