"""Stateful streams: admission control, single flight, idle eviction and teeing, on Structured Streaming.

Each keeps per key a few numbers of state. Batch and stream agree where a key's events come in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources.shared import shared_path


def admission(stream: DataFrame, key: str, ts: str, order: str, most: int = 20, minutes: int = 60) -> DataFrame:
    """(key, id, at, allowed) as events come; state is the window's start and its count."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    gap = minutes * 60_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        events = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = []
        for at in events["at"]:
            if start is None or start < at - gap:
                start, n, ok = int(at), 1, True
            else:
                ok = n < most
                n += ok
            allowed.append(bool(ok))
        state.update((start, n))
        yield pd.DataFrame({"key": group[0], "id": events["id"].to_numpy(), "at": events["at"].to_numpy(), "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(step, "key long, id long, at long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def single_flight(stream: DataFrame, key: str, ts: str, within: str = "5 minutes") -> DataFrame:
    """The first request of each key; later ones within the delay join it."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def idle_states(stream: DataFrame, key: str, ts: str, status: str, idle_minutes: int = 5) -> DataFrame:
    """(key, status, last, evicted) when a key changes, and once more when it has been idle in event time; running keys stay."""
    rows = stream.withWatermark(ts, "1 minute").select(F.col(key).cast("string").alias("key"), F.col(status).alias("status"), F.col(ts).alias("at"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status_, last = state.get
            state.remove()
            yield pd.DataFrame({"key": [group[0]], "status": [status_], "last": [last], "evicted": [True]})
            return
        events = pd.concat(list(batches)).sort_values("at")
        status_, last = events["status"].iloc[-1], int(events["at"].iloc[-1].timestamp() * 1000)
        state.update((status_, last))
        if status_ != "running":
            state.setTimeoutTimestamp(max(last + idle_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [group[0]], "status": [status_], "last": [last], "evicted": [False]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, status string, last long, evicted boolean", "status string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def lines_stream(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """(key, seq, line) as chunks of streams come, in order; the open line is the state. A null chunk ends its stream and gives its last line."""
    rows = chunks.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("s"), F.col(chunk).alias("t"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ("", 0)
        pieces, out = [held], []
        came = pd.concat(list(batches)).sort_values("s", kind="stable")
        for text in came["t"]:
            if text is None:
                out.append("".join(pieces))
                pieces = []
                continue
            *done, rest = text.split("\n")
            for line in done:
                out.append("".join([*pieces, line]))
                pieces = []
            pieces.append(rest)
        state.update(("".join(pieces), number + len(out)))
        yield pd.DataFrame({"key": group[0], "seq": range(number, number + len(out)), "line": out})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, line string", "held string, number long", "append", GroupStateTimeout.NoTimeout)


def batch_sink(root: str, keep: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink whose output is named by the micro-batch's number and overwritten, so a repeated batch leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        (batch if keep is None else batch.where(keep)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={number}")

    return write


def tee(stream: DataFrame, *sinks: Callable[[DataFrame, int], None], name: str = "tee", checkpoint: str | None = None):
    """Starts a stream whose micro-batches go to every sink; each is computed once. Gives the query.

    Where a sink fails the batch is repeated for all of them when the stream is started again with the same
    ``checkpoint``; with sinks such as ``batch_sink`` every row then stands once in each.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    place = checkpoint or shared_path(stream.sparkSession, f"{name}-checkpoint")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for the data there is now, through a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
