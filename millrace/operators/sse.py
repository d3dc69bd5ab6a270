"""Server-sent events: texts put together from ordered deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Chunks whose lines make one batch.
_ROWS = 256
DELTA = "type string, delta struct<text: string>"


def delta_text(line: Column) -> Column:
    """Text of a content delta line; null for other, malformed or empty ones."""
    data = F.from_json(F.substring(line, 7, 1 << 30), DELTA)
    return F.when(F.startswith(line, F.lit("data: ")) & (data["type"] == "content_block_delta") & (data["delta"]["text"] != ""), data["delta"]["text"])


def fold_text(lines: DataFrame, key: str = "stream_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """(key, text): the deltas of each stream in order, up to its first ``[DONE]``; a stream without any is empty."""
    rows = lines.select(key, F.col(seq).alias("s"), F.when(F.col(line) == "data: [DONE]", F.col(seq)).alias("end"), delta_text(F.col(line)).alias("t"))
    parts = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("s", "t"))))
    folded = rows.groupBy(key).agg(F.min("end").alias("end"), parts.alias("parts"))
    before = F.filter("parts", lambda p: F.col("end").isNull() | (p["s"] < F.col("end")))
    return folded.select(key, F.array_join(F.transform(before, lambda p: p["t"]), "").alias("text"))


def lines_of_chunks(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", carry: bool = True) -> DataFrame:
    """(key, seq, line) from chunks of a stream's bytes cut anywhere.

    With ``carry`` a line that a boundary cuts is carried into the next chunk: one pass over sorted chunks that holds no
    more than the open line and a few chunks, however long the stream is. Without it every chunk is split by itself,
    and a line that a boundary cuts is two broken ones; kept to show the difference.
    """
    if not carry:
        split = chunks.select(key, F.col(seq).alias("c"), F.posexplode(F.split(chunk, "\n")).alias("p", "line"))
        return split.select(key, (F.col("c") * (1 << 20) + F.col("p")).alias("seq"), "line")
    rows = chunks.select(key, F.col(seq).cast("long").alias("s"), F.coalesce(chunk, F.lit("")).alias("t")).where(F.col(key).isNotNull())
    kind = rows.schema[key].dataType
    return rows.repartition(key).sortWithinPartitions(key, "s").mapInArrow(carried, StructType([StructField(key, kind), StructField("seq", LongType()), StructField("line", StringType())]))


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of (stream, place, chunk) rows in order: only the open line is held from chunk to chunk, as the pieces it came in."""
    now, number, pieces = None, 0, []
    for batch in batches:
        kind = batch.schema.field(0).type
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            out: list[tuple] = []
            for stream, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if stream != now:
                    if now is not None:
                        out.append((now, number, "".join(pieces)))
                    now, number, pieces = stream, 0, []
                *done, rest = text.split("\n")
                for line in done:
                    out.append((now, number, "".join([*pieces, line])))
                    number, pieces = number + 1, []
                pieces.append(rest)
            yield _lines(out, kind)
    if now is not None:
        yield _lines([(now, number, "".join(pieces))], kind)


def _lines(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string()))], names=["k", "seq", "line"])
