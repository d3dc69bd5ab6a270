"""Catalog search by a stored table of postings: the first products of each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Products kept for a token: a page of the search.
MOST = 5
BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(catalog: DataFrame, path: str, code: str, name: str, most: int = MOST, buckets: int = BUCKETS) -> None:
    """Per token of ``name`` (parts between blanks) its least ``most`` codes with their ``position`` from 1, in hash buckets of the token.

    Repeated products count once; null names, null codes and empty tokens have no postings. Ranks are limited before the
    shuffle, so a token that a third of the catalog has sends ``most`` codes a task.
    """
    tokens = catalog.select(F.col(code).alias("code"), F.explode(F.split(name, " ")).alias("term")).where("code is not null and term <> ''")
    ranked = tokens.withColumn("position", F.dense_rank().over(Window.partitionBy("term").orderBy("code"))).where(F.col("position") <= most)
    postings = ranked.distinct().withColumn("bucket", _bucket(F.col("term"), buckets))
    postings.hint("rebalance", F.col("bucket")).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """The postings in some buckets; other partitions are not read."""
    return spark.read.schema("code long, term string, position int, bucket int").parquet(path).where(F.col("bucket").isin(wanted))


def search(terms: DataFrame, path: str, term: str = "term", buckets: int = BUCKETS) -> DataFrame:
    """(term, position, code) for the distinct ``terms`` that have products, by the table at ``path``.

    The driver learns the buckets of the terms only, at most ``buckets`` numbers.
    """
    asked = terms.select(F.col(term).alias("term")).distinct().withColumn("bucket", _bucket(F.col("term"), buckets))
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]
    return asked.join(postings(terms.sparkSession, path, wanted), ["bucket", "term"]).select("term", "position", "code")
