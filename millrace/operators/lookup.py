"""Lookups and joins: point lookups with a time to live, aliases, catalog enrichment, layered caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalize_key


def cache_lookup(cache: DataFrame, keys: DataFrame, now: Column, key: str = "cache_key") -> DataFrame:
    """Per key row: analysis, data_source and opff_data of a live entry (strictly after ``now``), else nulls.

    Empty keys miss; an entry without a source counts as ``ai``.
    """
    live = cache.where((F.col("expires_at") > now) & (F.col(key).cast("string") != ""))
    found = live.select(key, "analysis", F.coalesce("data_source", F.lit("ai")).alias("data_source"), "opff_data", F.lit(True).alias("hit"))
    return keys.join(found, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def one_row(df: DataFrame, key: str, value: Column) -> DataFrame:
    """The row of a key, which must be one; an error at run time otherwise."""
    found = df.where(F.col(key) == value)
    n = F.assert_true(F.col("__n") == 1, F.lit("expected exactly one row"))
    counted = found.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*df.columns)).alias("__row"))
    return counted.where(n.isNull()).select("__row.*")


def resolve_alias(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """``canonical``: the alias's target, or the key itself; one hop, aliases are kept flat."""
    flat = aliases.select(F.col("alias").alias("__alias"), F.col("target").alias("__target"))
    return rows.join(flat, rows[key] == flat["__alias"], "left").withColumn("canonical", F.coalesce("__target", key)).drop("__alias", "__target")


def enrich(scans: DataFrame, catalog: DataFrame, barcode: str, name: str, partial: str) -> DataFrame:
    """Scans with their catalog product: by barcode, else by partial name, else by full name; ``data_source`` tells.

    Catalog rows have ``barcode`` and ``product_name``; of products with one name key the least barcode stands. Null
    and empty names, and those of stop words alone, have no key and find nothing. Names are looked up only for scans
    that nothing before has found.
    """
    keys = catalog.select(normalize_key(F.col("product_name")).alias("__key"), "barcode").where("__key != ''")
    by_name = keys.groupBy("__key").agg(F.min("barcode").alias("__found"))
    codes = catalog.select(F.col("barcode").alias("__code")).distinct()
    out = scans.join(codes, scans[barcode] == codes["__code"], "left")
    before = ["__code"]
    for source, to in ((partial, "__partial"), (name, "__full")):
        keyed = by_name.select(F.col("__key").alias(f"{to}_key"), F.col("__found").alias(to))
        # a column of its own: as an expression the key would be made anew by the exchange and every comparison of the sort
        out = out.withColumn("__wanted", F.when(F.coalesce(*before).isNull(), normalize_key(F.col(source))))
        out = out.join(keyed, out["__wanted"] == keyed[f"{to}_key"], "left").drop(f"{to}_key", "__wanted")
        before.append(to)
    found = F.coalesce("__code", "__partial", "__full")
    out = out.withColumn("product_code", found).withColumn("data_source", F.when(found.isNotNull(), "enriched").otherwise("ai"))
    return out.drop("__code", "__partial", "__full")


def layered(keys: DataFrame, layers: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """First layer with a value wins; ``layer`` names it, ``expired`` if none has one."""
    out, values, names = keys, [], []
    for i, (name, layer) in enumerate(layers):
        side = layer.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(side, out[key] == side[f"__k{i}"], "left").drop(f"__k{i}")
        values.append(F.col(f"__v{i}"))
        names.append(F.when(F.col(f"__v{i}").isNotNull(), name))
    out = out.withColumn(value, F.coalesce(*values)).withColumn("layer", F.coalesce(*names, F.lit("expired")))
    return out.drop(*[f"__v{i}" for i in range(len(layers))])


def hit_counts(cache: DataFrame, hits: DataFrame, key: str, at: str) -> DataFrame:
    """Hit events added to a cache's counters; the last hit is the latest."""
    new = hits.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(at).alias("__last"))
    out = cache.join(new, key, "left")
    return out.withColumns(
        {"hit_count": (F.col("hit_count") + F.coalesce("__n", F.lit(0))).cast("long"), "last_hit_at": F.greatest("last_hit_at", "__last")}
    ).drop("__n", "__last")


def visible_to(df: DataFrame, owner: str, user: Column | None) -> DataFrame:
    """Row-level access: a user's own rows; without a user none."""
    return df.where(F.lit(False)) if user is None else df.where(F.col(owner) == user)
