"""Streaming and batch readers of event logs and of server-sent-event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SSE_SCHEMA = "stream_id long, seq long, line string"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A supplied table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}*.parquet")


def write_sse_lines(lines: DataFrame, path: str) -> None:
    """Event lines (stream_id, seq, line) as text files of many streams: a line bears its stream's id before a tab.

    A stream lies in one file and in order, so there are as many files as tasks and not as many as streams.
    """
    named = F.concat_ws("\t", F.coalesce(F.col("stream_id").cast("string"), F.lit("")), F.coalesce("line", F.lit("")))
    lines.repartition("stream_id").sortWithinPartitions("stream_id", "seq").select(named.alias("value")).write.option("maxRecordsPerFile", 0).text(path)


def sse_lines(spark: SparkSession, path: str, stream: bool = False, named: bool = False) -> DataFrame:
    """Lines of text files, one stream a file, as (stream file, line); the batch form tells their order as ``seq``.

    With ``named`` a file holds many streams as ``write_sse_lines`` leaves them, and ``stream_id`` takes the file's place.
    A large file is read as byte ranges that begin and end with lines, by as many tasks; ``seq`` is the range's offset
    and a number that grows along the range, so it orders lines but does not count them.
    """
    file = F.col("_metadata.file_path").alias("stream_file")
    value = F.col("value")
    line = value.alias("line")
    if named:
        file = F.nullif(F.substring_index("value", "\t", 1), F.lit("")).cast("long").alias("stream_id")
        line = F.substring(value, F.instr(value, "\t") + 1, F.length(value)).alias("line")
    if stream:
        return spark.readStream.text(path).select(file, line)
    place = F.struct(F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("number"))
    return spark.read.text(path, lineSep="\n").select(file, place.alias("seq"), line)
