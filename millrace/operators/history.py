"""Scan-history operators: top-k per user, anti-join merge, recency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_history(remote: DataFrame, local: DataFrame, limit: int = 50, key: str = "id", date: str = "date_scanned") -> DataFrame:
    """Newest ``limit`` of the remote top ``limit`` and of the local rows whose key is not among them.

    On equal dates unsynced local rows (``src`` 0) come before remote ones (``src`` 1), then by key.
    """
    newest = remote.orderBy(F.desc(date), F.asc(key)).limit(limit)
    unsynced = local.join(newest.select(key), key, "left_anti")
    both = unsynced.withColumn("src", F.lit(0)).unionByName(newest.withColumn("src", F.lit(1)))
    return both.orderBy(F.desc(date), F.asc("src"), F.asc(key)).limit(limit)


def top_per_user(entries: DataFrame, most: int, user: str = "user_id", key: str = "id", date: str = "date_scanned") -> DataFrame:
    """Newest ``most`` entries of every user, with their position."""
    w = Window.partitionBy(user).orderBy(F.desc(date), F.asc(key))
    return entries.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def cap_newest(entries: DataFrame, most: int, user: str = "user_id", key: str = "id", date: str = "date_scanned", source: str = "src") -> DataFrame:
    """Newest ``most`` of every user over several sources; ties go by source, then key."""
    w = Window.partitionBy(user).orderBy(F.desc(date), F.asc(source), F.asc(key))
    return entries.withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= most).drop("__p")


def prepend_cap(entries: DataFrame, user: str, inserted: str, most: int) -> DataFrame:
    """Last ``most`` insertions of every user, newest first; the order is that of insertion, not of dates."""
    w = Window.partitionBy(user).orderBy(F.desc(inserted))
    return entries.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


#: Stored column and document field of a history entry.
FIELDS = (
    ("id", "id"), ("user_id", "user_id"), ("product_name", "productName"), ("overall_score", "overallScore"), ("pet_type", "petType"), ("date_scanned", "dateScanned"), ("cache_key", "cacheKey"),
    ("scan_mode", "scanMode"), ("data_source", "dataSource"), ("photo_uri", "photoUri"), ("safety_level", "safetyLevel"),
)


def from_row(rows: DataFrame) -> DataFrame:
    """Stored rows as documents; only fields that the rows have."""
    return rows.select(*[F.col(a).alias(b) for a, b in FIELDS if a in rows.columns])


def to_row(entries: DataFrame) -> DataFrame:
    """Documents as stored rows; the safety level is kept too."""
    return entries.select(*[F.col(b).alias(a) for a, b in FIELDS if b in entries.columns])
