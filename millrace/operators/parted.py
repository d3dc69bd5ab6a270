"""Tables in parts: an upsert, an update or a clean-up writes only the parts that it touches.

A row's part is a hash bucket of its key and, where the table has a time of expiry, the day of that. A change reads the
keys of the buckets it falls into, rewrites the parts that hold changed rows under the next version, and then writes the
heads: one row for each part with the version that holds it. What no head names does not count, so a change that fails
half-way leaves the table as it was and is simply run again. One writer at a time: a second one finds the version taken.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.tables import latest_by, read_if_there, update_latest, upsert
from millrace.sources.shared import written

#: The day of rows that never expire: after every other.
NEVER = (1 << 31) - 1
Part = tuple[int, int]


@dataclass(frozen=True)
class PartedTable:
    """A table at ``root`` with unique ``keys``; null keys are keys. ``expires`` names a timestamp, null for never.

    The heads, at most ``buckets`` times the days of expiry in use, go through the driver; choose ``buckets`` so that a
    part is a few gigabytes. Versions before the last stay in place for readers that have begun.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 256
    expires: str | None = None

    def heads(self) -> tuple[int, list[Row]]:
        """The last version (0 where there is none) and, for each part, bucket, day and the version that holds it."""
        held = read_if_there(self.spark, f"{self.root}/heads")
        if held is None:
            return 0, []
        version = held.agg(F.max("version")).first()[0]
        return version, held.where((F.col("version") == version) & (F.col("bucket") >= 0)).select("bucket", "day", "made").collect()

    def rows(self) -> DataFrame:
        return self._rows(self.heads()[1])

    def upsert(self, changes: DataFrame, order: str, kept: tuple[str, ...] = ()) -> int:
        """The latest change of each key by ``order`` put in, columns in ``kept`` surviving; gives the parts written.

        A row whose expiry moves to another day leaves its old part, which is rewritten too.
        """
        version, heads = self.heads()
        newest = written(self._dealt(latest_by(changes, list(self.keys), F.col(order))), "changes")
        touched = self._parts(newest)
        near = self._near(heads, newest)
        touched |= self._holding(near, newest)
        base = self._rows(h for h in near if (h.bucket, h.day) in touched)
        return self._commit(upsert(base, newest.drop("__bucket", "__day"), list(self.keys), order, kept), touched, version, heads)

    def update(self, updates: DataFrame, column: str, order: str) -> int:
        """Last writer wins for one column of rows that are there; parts without such rows are not written. Null keys update nothing."""
        if column in self.keys or column == self.expires or len(self.keys) != 1:
            raise ValueError("an update sets a column that no part depends on, by a key of one column")
        version, heads = self.heads()
        newest = written(self._dealt_by_key(latest_by(updates.where(F.col(self.keys[0]).isNotNull()), list(self.keys), F.col(order))), "updates")
        near = self._near(heads, newest)
        touched = self._holding(near, newest)
        base = self._rows(h for h in near if (h.bucket, h.day) in touched)
        return self._commit(update_latest(base, newest, self.keys[0], column, order), touched, version, heads)

    def delete_expired(self, now: Column) -> int:
        """Rows that expired strictly before ``now`` go: whole days by their heads alone, only the day of ``now`` is read."""
        if self.expires is None:
            raise ValueError("the table has no time of expiry")
        version, heads = self.heads()
        today = self.spark.range(1).select(_day(now)).first()[0]
        touched = {(h.bucket, h.day) for h in heads if h.day <= today}
        left = self._rows(h for h in heads if h.day == today).where(F.col(self.expires) >= now)
        return self._commit(left, touched, version, heads)

    def _dealt_by_key(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _dealt(self, df: DataFrame) -> DataFrame:
        day = F.lit(NEVER) if self.expires is None else _day(F.col(self.expires))
        return self._dealt_by_key(df).withColumn("__day", day)

    def _rows(self, heads: Iterable[Row]) -> DataFrame:
        paths = [f"{self.root}/data/version={h.made}/__bucket={h.bucket}/__day={h.day}" for h in heads]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    @staticmethod
    def _parts(dealt: DataFrame) -> set[Part]:
        return {(r[0], r[1]) for r in dealt.select("__bucket", "__day").distinct().collect()}

    @staticmethod
    def _near(heads: list[Row], newest: DataFrame) -> list[Row]:
        buckets = {r[0] for r in newest.select("__bucket").distinct().collect()}
        return [h for h in heads if h.bucket in buckets]

    def _holding(self, near: list[Row], newest: DataFrame) -> set[Part]:
        """The parts that hold a key of ``newest``; only keys and expiry are read."""
        new = newest.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(self.keys)]
        return self._parts(self._dealt(self._rows(near)).join(new, same, "left_semi"))

    def _commit(self, made: DataFrame, touched: set[Part], version: int, heads: list[Row]) -> int:
        """Writes ``made`` in place of the parts ``touched``, and the heads after it."""
        if not touched:
            return 0
        following = version + 1
        path = f"{self.root}/data/version={following}"
        # parts of even size, large ones over several tasks
        dealt = self._dealt(made.select(*self.schema.names)).hint("rebalance", F.col("__bucket"), F.col("__day"))
        dealt.write.mode("overwrite").partitionBy("__bucket", "__day").parquet(path)
        new = self._parts(self.spark.read.schema("__bucket int, __day int").parquet(path))
        held = [(h.bucket, h.day, h.made) for h in heads if (h.bucket, h.day) not in touched]
        # a row of its own, so that a table without parts has heads
        rows = [(-1, 0, following), *held, *[(b, d, following) for b, d in sorted(new)]]
        self.spark.createDataFrame(rows, "bucket int, day int, made int").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/heads/version={following}")
        return len(touched)


def _day(at: Column) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(at) / 86400).cast("int"), F.lit(NEVER))
