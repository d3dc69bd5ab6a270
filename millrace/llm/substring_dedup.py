"""Substring deduplication by De Bruijn compaction over words.

Every window of 50 words is an edge of the graph. Edges that follow one another in a text and share their least
12-word hash are compacted where they stand into one path piece, found again in any text that repeats it; a piece
is named by that hash (its minimizer) and by its whole content. Spark then joins pieces:

* texts that hold the same piece share a nonbranching path, and all its edges belong first to the least document;
* where a minimizer has several pieces the path branches there; only these pieces are spread out into single edges,
  which are grouped by their own hashes.

Every repeated piece or run of edges keeps its coordinates in the text that owns it. The words there are read again
and their SHA-256 goes with the copy's coordinates, so a span is cut out only where the words themselves are equal.
All groupings are sums and minima with map-side combination, so a passage that a third of all documents share
meets no single task; nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, discard, in_chunks, materialize
from millrace.llm.hashing import Runs, sliding_min

MINIMIZER = 12
_NULL_KEY = (1 << 63) - 1
_CHARS = 1_000_000


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Null keys come after all others; ``tag`` tells texts under one key apart."""
    rank = F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY))
    return docs.select(rank.alias("doc"), F.xxhash64(text).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def path_pieces(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per path piece of a text: minimizer, content, doc, tag, first word, number of edges."""
    schema = "mini long, content long, doc long, tag long, start int, edges int"
    arrow, width = arrow_schema(docs.sparkSession, schema), window - MINIMIZER + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).to_pylist()
            for a, b in in_chunks(texts, _CHARS):
                runs = Runs([t.encode().split() for t in texts[a:b]])
                place, which = runs.starts(window)
                if not len(place):
                    continue
                mini = sliding_min(runs.grams(MINIMIZER), width)[place]
                new = np.ones(len(place), dtype=bool)
                new[1:] = (mini[1:] != mini[:-1]) | (which[1:] != which[:-1])
                at = np.flatnonzero(new)
                edges = np.diff(np.append(at, len(place)))
                start, mine = place[at], which[at]
                content = runs.spans(start, edges + window - 1)
                columns = (mini[at].view(np.int64), content.view(np.int64), doc[a:b][mine], tag[a:b][mine], (start - runs.first[mine]).astype(np.int32), edges.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _rows(docs, key, text).mapInArrow(run, schema)


def _edges(texts_and_pieces: DataFrame, window: int) -> DataFrame:
    """Single edges of given pieces: minimizer, edge hash, doc, tag, first word."""
    schema = "mini long, edge long, doc long, tag long, start int"
    arrow = arrow_schema(texts_and_pieces.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, pieces = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in in_chunks(texts, _CHARS):
                runs = Runs([t.encode().split() for t in texts[a:b]])
                grams = runs.grams(window)
                own = [(d, p["start"], p["edges"], p["mini"]) for d in range(b - a) for p in pieces[a + d]]
                d, start, n, mini = (np.array(x, dtype=np.int64) for x in zip(*own))
                each = np.repeat(np.arange(len(n)), n)
                within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                first = start[each] + within
                columns = (mini[each], grams[runs.first[d[each]] + first].view(np.int64), doc[a:b][d[each]], tag[a:b][d[each]], first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return texts_and_pieces.select("doc", "tag", "text", "pieces").mapInArrow(run, schema)


def _once(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One of the rows equal in key and text; copies fall together on the map side."""
    return _rows(docs, key, text).groupBy("doc", "tag").agg(F.first("text").alias("text"))


def _with_owner(rows: DataFrame, by: list[str]) -> DataFrame:
    """Copies among rows (``by``, owner, doc, tag, start, edges), each with a place in its owner: otag, ostart."""
    places = rows.where("doc = owner").groupBy(*by).agg(F.min(F.struct("tag", "start")).alias("at"))
    places = materialize(places.select(*by, F.col("at.tag").alias("otag"), F.col("at.start").alias("ostart")), "owner-places")
    return rows.where("owner < doc").join(places, by).select("doc", "tag", "start", "edges", "owner", "otag", "ostart").distinct()


def _runs(singles: DataFrame) -> DataFrame:
    """Single edges that follow one another both in the copy and in its owner, as one span."""
    line = ["doc", "tag", "owner", "otag", "shift"]
    shifted = singles.withColumn("shift", F.col("start") - F.col("ostart"))
    numbered = shifted.withColumn("run", F.col("start") - F.row_number().over(Window.partitionBy(*line).orderBy("start")))
    runs = numbered.groupBy(*line, "run").agg(F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("edges"), F.min("ostart").alias("ostart"))
    return runs.select("doc", "tag", "start", "edges", "owner", "otag", "ostart")


def _digest(words: list[bytes], start: int, edges: int, window: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + edges + window - 1])).digest()


def _owner_digests(spans: DataFrame, docs: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """SHA-256 of the words of every span in its owner: owner, otag, ostart, edges, words."""
    schema = "owner long, otag long, ostart int, edges int, words binary"
    arrow = arrow_schema(docs.sparkSession, schema)
    held = spans.select("owner", "otag", F.struct("ostart", "edges").alias("at")).distinct().groupBy("owner", "otag").agg(F.collect_list("at").alias("held"))
    held = materialize(held.withColumnsRenamed({"owner": "doc", "otag": "tag"}), "owner-spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, body, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = body.as_py().encode().split()
                rows = [(doc, tag, p["ostart"], p["edges"], _digest(words, p["ostart"], p["edges"], window)) for p in places.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return _once(docs, key, text).join(held, ["doc", "tag"]).select("doc", "tag", "text", "held").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with windows that a lesser document holds: doc, tag, ``spans`` of first word, number of windows, words' digest."""
    every_piece = materialize(path_pieces(docs, window, key, text), "paths")
    # minimizers of one document alone cannot repeat: everything after goes over the rest
    # (what joins a hot key is written first: a join of two plain exchanges can be split, one with an aggregate cannot)
    widely = materialize(every_piece.groupBy("mini").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("mini"), "wide-minimizers")
    pieces = materialize(every_piece.join(widely, "mini").distinct(), "shared-paths")
    discard(every_piece, widely)
    owners = materialize(pieces.groupBy("mini", "content").agg(F.min("doc").alias("owner")), "path-owners")
    judged = materialize(pieces.join(owners, ["mini", "content"]), "judged-paths")
    discard(pieces)
    copies = _with_owner(judged, ["mini", "content"])

    branching = owners.groupBy("mini").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high").select("mini")
    branching = materialize(branching, "branching-minimizers")
    open_pieces = judged.where("doc = owner").join(branching, "mini", "left_semi").select("doc", "tag", F.struct("mini", "start", "edges").alias("piece"))
    held = open_pieces.groupBy("doc", "tag").agg(F.collect_list("piece").alias("pieces"))
    edges = materialize(_edges(_once(docs, key, text).join(held, ["doc", "tag"]), window), "edges")
    shared = edges.groupBy("mini", "edge").agg(F.min("doc").alias("owner"), F.max("doc").alias("high")).where("owner < high").drop("high")
    shared = materialize(shared, "shared-edges")
    met = materialize(edges.join(shared, ["mini", "edge"]).withColumn("edges", F.lit(1)), "met-edges")
    discard(edges, shared)
    spans = materialize(copies.unionByName(_runs(_with_owner(met, ["mini", "edge"]))), "copied-spans")
    discard(owners, judged, branching, met)

    digests = materialize(_owner_digests(spans, docs, window, key, text), "owner-digests")
    known = spans.join(digests, ["owner", "otag", "ostart", "edges"])
    known = known.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "edges", "words")).alias("spans"))
    known = materialize(known, "spans")
    discard(spans, digests)
    return known


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the words left, if asked for).

    A word goes if a window over it also starts in a document with a smaller key. A null text has no words; a null
    key counts as larger than all others; rows with one key never remove each other's words. Repeated rows each give
    a row, and are one to the search.
    """
    spans = repeated_spans(docs, window, key, text)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode().split()
                kept, n = words, len(words)
                if held:
                    step = np.zeros(n + 1, dtype=np.int64)
                    for s in held:
                        if _digest(words, s["start"], s["edges"], window) == s["words"]:
                            step[s["start"]] += 1
                            step[s["start"] + s["edges"] + window - 1] -= 1
                    gone = np.cumsum(step[:n]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((None if doc == _NULL_KEY else doc, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else pa.RecordBatch.from_pylist([], schema=arrow)

    return _rows(docs, key, text).join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(run, schema)
