"""Tables that change: merges, updates and deletes as new versions of a table.

Parquet has no MERGE; each operator gives the next version as a DataFrame, and ``swap`` writes it beside the old one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the greatest by ``order``, as an aggregation with map-side combination."""
    rest = [c for c in rows.columns if c not in keys]
    named = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*named, *rest)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the latest change of each key put in; columns in ``kept`` survive a conflict.

    ``changes`` has the columns of ``base`` and ``order``, which decides between changes of one key.
    """
    newest = latest_by(changes, keys, F.col(order)).drop(order)
    b, n = base.alias("b"), newest.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = b.withColumn("__old", F.lit(True)).alias("b").join(n, on, "full")
    columns = []
    for c in base.columns:
        if c in keys:
            columns.append(F.coalesce(f"n.{c}", f"b.{c}").alias(c))
        else:
            new_wins = F.col("n.__new").isNotNull() if c not in kept else F.col("n.__new").isNotNull() & F.col("b.__old").isNull()
            columns.append(F.when(new_wins, F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return joined.select(*columns)


def update_latest(base: DataFrame, updates: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Last writer wins for one column; rows without updates keep their value."""
    newest = latest_by(updates, [key], F.col(order)).select(key, F.col(column).alias("__v"))
    joined = base.join(newest, key, "left")
    return joined.select(*[F.coalesce("__v", c).alias(c) if c == column else c for c in base.columns])


def delete_where(base: DataFrame, gone: Column) -> DataFrame:
    """Rows for which ``gone`` is not true."""
    return base.where(~F.coalesce(gone, F.lit(False)))


def delete_expired(base: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Strictly expired rows go; a row that expires just now stays (though no lookup finds it)."""
    return delete_where(base, F.col(expires) < now)


def delete_stale(base: DataFrame, now: Column, hours: int = 24, start: str = "window_start") -> DataFrame:
    return delete_where(base, F.col(start) < now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def affected(base: DataFrame, gone: Column) -> DataFrame:
    """How many rows a delete would take, as one row ``n``."""
    return base.agg(F.count_if(gone).alias("n"))


def cascade_delete(children: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each child table without the rows of deleted parents; null references stay."""
    ids = deleted.select(F.col(key).alias("__id")).distinct()
    return {name: df.join(ids, df[ref] == ids["__id"], "left_anti") for name, (df, ref) in children.items()}


def recency_list(writes: DataFrame, keys: list[str], owner: list[str], order: list[Column], most: int) -> DataFrame:
    """Last write per key, newest first per owner, with ``position`` and whether it is ``evicted`` beyond ``most``.

    Recency goes by writes; reads do not count.
    """
    last = latest_by(writes, [*owner, *keys], *order)
    w = Window.partitionBy(*owner).orderBy(*[o.desc() for o in order], *keys)
    return last.withColumn("position", F.row_number().over(w)).withColumn("evicted", F.col("position") > most)


def migrate_once(target: DataFrame, legacy: DataFrame, current: DataFrame, done: DataFrame, owner: str, keys: list[str], order: str, present: DataFrame | None = None) -> DataFrame:
    """Idempotent migration: owners not in ``done`` get their legacy rows upserted, or their current rows if they have none.

    ``present`` holds the owners that have a legacy list at all: one that is there but empty leaves its owner's history
    as it is, current rows included. Without it an owner has a list exactly if it has legacy rows.
    """
    held = (legacy if present is None else present).select(owner).distinct()
    open_legacy = legacy.join(done.select(owner), owner, "left_anti")
    open_current = current.join(done.select(owner), owner, "left_anti").join(held, owner, "left_anti")
    return upsert(target, open_legacy.unionByName(open_current), keys, order)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def migrated_table(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(table, markers, version) as committed at ``root``: data that no marker names does not count."""
    markers = read_if_there(spark, f"{root}/markers")
    if markers is None:
        return None, None, 0
    version = markers.agg(F.max("version")).first()[0] or 0
    return read_if_there(spark, f"{root}/data/version={version}"), markers, version


def migrate(root: str, target: DataFrame, legacy: DataFrame, current: DataFrame, owners: DataFrame, owner: str, keys: list[str], order: str, present: DataFrame | None = None, write_marker=None) -> DataFrame:
    """Migrates ``owners`` that no marker at ``root`` names, and gives the table as it is then.

    The new version of the table is written first, and only then the marker: one row for each owner, with the version
    that holds its rows. A failure in between leaves no marker, so the next run does it again over the same version;
    after success a run finds the markers and changes nothing. ``target`` counts until there is a committed version.
    """
    spark = target.sparkSession
    table, markers, version = migrated_table(spark, root)
    base = target if table is None else table.select(*target.columns)
    done = owners.select(owner).where("false") if markers is None else markers.select(owner)
    fresh = owners.select(owner).distinct().join(done, owner, "left_anti")
    if fresh.isEmpty():
        return base
    todo = lambda df: df.join(fresh, owner, "left_semi")
    following = version + 1
    made = migrate_once(base, todo(legacy), todo(current), done, owner, keys, order, present)
    made.write.mode("overwrite").parquet(f"{root}/data/version={following}")
    mark = write_marker or (lambda df, path: df.write.mode("overwrite").parquet(path))
    mark(fresh.withColumn("version", F.lit(following)), f"{root}/markers/run={following}")
    return migrated_table(spark, root)[0].select(*target.columns)


def swap(df: DataFrame, root: str, version: str) -> str:
    """Write the next version of a table beside the others, never over one that is being read; gives its path."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
