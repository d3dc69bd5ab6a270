"""Progressive parse of JSON that is still arriving: open strings, arrays and objects are closed.

An automaton keeps the open brackets, the last place where the text may end, and the piece of a token that is still
open; it goes on from the last chunk, and nothing is read twice. Built-in expressions cannot express this, so it runs
in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]+")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]+')
_SCALAR = re.compile(r"[^\s,\]}:\[{\"]+")
_WHOLE = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_ESCAPE_OPEN = re.compile(r"\\(?:u[0-9a-fA-F]{0,3})?\Z")


class Closer:
    """``feed`` chunks in order; ``closed`` gives the longest prefix that can be closed into a document, closed.

    An unfinished string value ends where it stops or breaks, an unfinished escape in it goes; an unfinished key, literal or number
    goes. What follows an error or the document's end is left out.
    """

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0  # characters in ``parts``
        self.stack: list[str] = []
        self.wants = "value"  # value, item (or end of array), key, name (or end of object), colon, next, end
        self.safe = 0  # the text may end here, with the brackets that are open now
        self.string: str | None = None  # "key" or "value" while within one
        self.open = ""  # escape or scalar that the last chunk left unfinished
        self.dead = False
        self.broken: int | None = None  # where a string turned out to be none

    def feed(self, chunk: str) -> Closer:
        if self.dead or not chunk:
            return self
        text, at = self.open + chunk, 0
        start = self.size - len(self.open)
        self.parts.append(chunk)
        self.size += len(chunk)
        self.open = ""
        while at < len(text) and not self.dead:
            at = self._in_string(text, at, start) if self.string else self._outside(text, at, start)
        return self

    def _in_string(self, text: str, at: int, start: int) -> int:
        if found := _PLAIN.match(text, at):
            return found.end()
        if text[at] == '"':
            if self.string == "key":
                self.wants = "colon"
            else:
                self._valued(start + at + 1)
            self.string = None
            return at + 1
        if found := _ESCAPE.match(text, at):
            return found.end()
        if _ESCAPE_OPEN.match(text, at):
            self.open = text[at:]
            return len(text)
        self.dead, self.broken = True, start + at
        return at

    def _valued(self, end: int) -> None:
        self.wants, self.safe = ("next" if self.stack else "end"), end

    def _outside(self, text: str, at: int, start: int) -> int:
        if found := _SPACE.match(text, at):
            if self.wants in ("item", "name", "next", "end"):
                self.safe = start + found.end()
            return found.end()
        ch = text[at]
        takes_value = self.wants in ("value", "item")
        if ch == '"' and (takes_value or self.wants in ("key", "name")):
            self.string = "value" if takes_value else "key"
        elif ch in "{[" and takes_value:
            self.stack.append("}" if ch == "{" else "]")
            self.wants, self.safe = ("name" if ch == "{" else "item"), start + at + 1
        elif ch in "}]" and self.stack and self.stack[-1] == ch and self.wants in ("next", "name" if ch == "}" else "item"):
            self.stack.pop()
            self._valued(start + at + 1)
        elif ch == "," and self.wants == "next":
            self.wants = "key" if self.stack[-1] == "}" else "value"
        elif ch == ":" and self.wants == "colon":
            self.wants = "value"
        elif takes_value and (found := _SCALAR.match(text, at)):
            if found.end() == len(text):
                self.open = found[0]
            elif _WHOLE.fullmatch(found[0]):
                self._valued(start + found.end())
            else:
                self.dead = True
            return found.end()
        else:
            self.dead = True
        return at + 1

    def closed(self) -> str | None:
        text = "".join(self.parts) if len(self.parts) != 1 else self.parts[0]
        self.parts = [text]
        closing = "".join(reversed(self.stack))
        if self.string == "value":
            return text[: self.size - len(self.open) if self.broken is None else self.broken] + '"' + closing
        if self.open and self.string is None and _WHOLE.fullmatch(self.open):
            return text + closing
        return text[: self.safe] + closing if self.safe else None


def complete(text: str | None) -> str | None:
    """The longest prefix that can be closed into a document, closed; null if there is none."""
    return None if text is None else Closer().feed(text).closed()


def complete_json(text: Column) -> Column:
    """``complete`` over a column."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(complete, na_action="ignore")

    return run(text)


def progressive(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(key, seq, closed) for every chunk of every stream: its document so far. Streams are read in one pass, each in order."""
    rows = chunks.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk")).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closer = None, Closer()
        for batch in batches:
            out, begin, held = [], 0, 0
            for i, (k, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if k != now:
                    now, closer = k, Closer()
                out.append(closer.feed(text or "").closed())
                held += len(out[-1] or "")
                if held > 8_000_000:  # a batch of results of bounded size
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin : i + 1], batch.column(1)[begin : i + 1], pa.array(out, pa.string())], names=["key", "seq", "closed"])
                    out, begin, held = [], i + 1, 0
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:], batch.column(1)[begin:], pa.array(out, pa.string())], names=["key", "seq", "closed"])

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key long, seq long, closed string")
