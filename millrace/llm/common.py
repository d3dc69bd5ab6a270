"""What the operators share: the word rule, shared-folder tables, bounded text batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/millrace/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()  # the driver drops shuffle files of plans that are done with only once their objects are gone
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once what was made of them is itself written."""
    for df in tables:
        _delete(df.sparkSession, df._table_path)


def cleanup(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; call when its results have been read."""
    _delete(spark, shared_dir(spark))


def in_chunks(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters at most; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def map_chunks(
    df: DataFrame, columns: list[str], text: str, fn: Callable[[dict[str, list]], dict[str, Iterable]], schema: str, most: int = 4_000_000
) -> DataFrame:
    """``mapInArrow`` over chunks of bounded text size.

    ``fn`` gets the columns of a chunk as lists and returns those of the result; their number of rows may differ.
    """
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {c: batch.column(c).to_pylist() for c in columns}
            for a, b in in_chunks(held[text], most):
                made = fn({c: v[a:b] for c, v in held.items()})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
