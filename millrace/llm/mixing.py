"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get targets (weights, with no source above a number of epochs of its own size). The targets become
integer numbers of equal blocks of words by the highest quotients ``target / (2 k + 1)``; the blocks of a source
are apportioned to its shards the same way, by the shards' sizes. A shard is a hash share of a source's documents
in seeded order, laid end to end and cut into blocks; from a seeded start, as many blocks as the quota says are
taken in turn, around the end as often as needed. Since the order is seeded, neighbouring blocks are a random
sample of whole documents, and only a shard's first and last block cut one.

Only totals pass through the apportionment: one row per source, ``MOST_SOURCES`` at most (checked), and one row per
``shard_docs`` documents of a source, so 500,000 small rows where one source has a billion documents. Documents are
placed by windows over shards of about ``shard_docs`` rows, so a hot source is many small sorts. Equal rows are laid out
as one row with a number of copies, so they are no hot key.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, map_chunks, materialize, n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources are ordered and apportioned in one task; finer owners than this (single pages, say) are no sources.
MOST_SOURCES = 1_000_000


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients ``votes / (2 k + 1)``; ties go to the earlier party; none gets more than its cap.

    A divisor found by bisection gives all but the last few seats at once, the heap of quotients the rest.
    """
    votes = np.asarray(votes, dtype=np.float64)
    caps = np.full(len(votes), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, dtype=np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = int(min(seats, int(np.minimum(caps, seats).sum())))
    given = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return given

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), caps)

    low, high = votes.sum() / (seats * 4.0 + 4 * len(votes)), 2.0 * votes.max() + 1.0
    while at(low).sum() < seats:
        low /= 2
    for _ in range(100):
        middle = (low + high) / 2
        if at(middle).sum() <= seats:
            high = middle
        else:
            low = middle
    given = at(high)
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in np.flatnonzero(given < caps)]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """One row per source (null is one): n_docs, source_size, weight, target.

    Weights repeat over the sources by code point, null last. The targets sum to ``share`` of all sizes, as far as
    ``epochs`` times the sizes allow: what is above a source's limit goes to the others by weight until none is above.
    """
    return _targets(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), weights, share, epochs)


def _targets(dims: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    # one row per source from here on: the windows without keys hold no documents
    ranked = dims.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    limited = ranked.withColumn("weight", weight).withColumn("limit", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    stepped = limited.withColumns(
        {
            "left": share * F.sum("source_size").over(whole)
            - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.col("left") / F.col("open")
    fits = F.when(level * F.col("weight") <= F.col("limit"), level)
    first = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(first * F.col("weight"), F.col("limit")))
    return stepped.withColumn("target", target.cast("double")).select("source", "rank", "n_docs", "source_size", "weight", "target")


def _apportion_sources(block: int, epochs: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        caps = np.floor(epochs * np.ceil(pdf["source_size"] / block)).astype("int64")
        pdf["blocks"] = sainte_lague(pdf["target"].to_numpy(), int(round(pdf["target"].sum() / block)), caps.to_numpy())
        return pdf

    return run


def _apportion_shards(block: int, epochs: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        caps = np.floor(epochs * np.ceil(pdf["shard_size"] / block)).astype("int64")
        pdf["quota"] = sainte_lague(pdf["shard_size"].to_numpy(), int(pdf["blocks"].iloc[0]), caps.to_numpy())
        return pdf[["rank", "shard", "shard_size", "quota"]]

    return run


def plan_mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: float = 2.0,
    block: int = 16,
    shard_docs: int = 2000,
    seed: int = 20240,
) -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target, ``taken``, and the two runs of its words that are taken.

    ``base`` is how often all its words are taken; ``from1``/``to1`` and ``from2``/``to2`` are word ranges taken once
    more (empty where from >= to). Null or empty texts have size 0 and are taken 0 times. Rows equal in key, text and
    source are laid out one after another, each with its own share, and numbered by ``copy`` from 1. ``doc_hash`` tells
    apart rows of one key with different texts. More than ``MOST_SOURCES`` sources raise an error.
    """
    sizes = materialize(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("doc_hash")),
        "mix-sizes",
    )
    totals = materialize(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "mix-totals")
    if totals.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    dims = _targets(totals, weights, share, epochs)
    fields = "source string, rank int, n_docs long, source_size long, weight double, target double, blocks long"
    dims = dims.groupBy().applyInPandas(_apportion_sources(block, epochs), fields)
    shards = F.ceil(F.col("n_docs") / shard_docs).cast("int")
    dims = materialize(dims.withColumn("shards", F.greatest(F.lit(1), shards)), "mix-sources")

    seeded = F.xxhash64(F.lit(seed), "doc_id", "doc_hash")
    copied = sizes.groupBy("doc_id", "source", "size", "doc_hash").agg(F.count(F.lit(1)).alias("copies"))
    placed = copied.withColumn("held", F.struct("source")).join(
        dims.select(F.struct("source").alias("held"), "rank", "source_size", "target", "blocks", "shards"), "held"
    )
    placed = placed.withColumn("shard", F.pmod(seeded, F.col("shards")).cast("int"))
    words = F.col("size") * F.col("copies")
    by_shard = placed.groupBy("rank", "shard").agg(F.sum(words).alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = by_shard.groupBy("rank").applyInPandas(_apportion_shards(block, epochs), "rank int, shard int, shard_size long, quota long")

    in_order = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), seeded), "doc_id", "doc_hash")
    laid = placed.withColumn("end", F.sum(words).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(quotas, ["rank", "shard"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    laid = laid.withColumn("start", F.col("end") - F.col("size") * (F.col("copies") - F.col("copy") + 1))
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    more = F.col("quota") % n
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), n) * block
    until = first + more * block
    wraps = n * block
    laid = laid.withColumns({"base": F.floor(F.col("quota") / n).cast("long"), "first": first, "until": until, "wraps": wraps})
    clip = lambda c: F.least(F.greatest(c - F.col("start"), F.lit(0)), F.col("size")).cast("long")
    laid = laid.withColumns(
        {
            "from1": clip(F.col("first")),
            "to1": clip(F.least("until", "wraps")),
            "from2": F.lit(0).cast("long"),
            "to2": F.greatest(F.lit(0), clip(F.col("until") - F.col("wraps"))),
        }
    )
    again = F.greatest(F.lit(0), F.col("to1") - F.col("from1")) + F.greatest(F.lit(0), F.col("to2") - F.col("from2"))
    taken = (F.col("base") * F.col("size") + again).cast("long")
    return laid.select("doc_id", "doc_hash", "source", "copy", "size", "source_size", "target", taken.alias("taken"), "base", "from1", "to1", "from2", "to2")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target and taken (see ``plan_mix``)."""
    return plan_mix(docs, **how).select("doc_id", "size", "source_size", "target", "taken")


_PLAN = ("size", "base", "from1", "to1", "from2", "to2")


def _taken_text(text: str, size: int, base: int, *runs: int) -> str:
    """A text's taken words: the whole text ``base`` times, then the two runs of words, on lines of their own."""
    parts = [text] * base
    spans = None
    for a, b in (runs[:2], runs[2:]):
        if a >= b:
            continue
        if b - a == size:
            parts.append(text)
            continue
        spans = spans or [m.span() for m in re.finditer(WORD, text)]
        parts.append(text[spans[a][0] : spans[b - 1][1]])
    return "\n".join(parts)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: rows that it takes no word of go, a row's text holds its taken words.

    A whole text is kept as it is; repeats and partial runs follow one another on new lines. Other columns stay. Every
    row gets the share planned for its key, text and source; of equal rows, each copy's share goes to one.
    """
    plan = plan_mix(docs, key=key, text=text, source=source, **how).where(F.col("taken") > 0)
    plan = plan.select(*[F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "doc_hash", "source", "copy", *_PLAN)])
    mine = docs.withColumn("__hash", F.xxhash64(text))
    # rows equal in key, text and source differ in other columns at most: those order them, whatever the run
    equal = Window.partitionBy(key, "__hash", source).orderBy(F.xxhash64(*docs.columns))
    mine = mine.withColumn("__copy", F.row_number().over(equal).cast("long"))
    same = mine[key].eqNullSafe(plan["__mix_doc_id"]) & (mine["__hash"] == plan["__mix_doc_hash"]) & mine[source].eqNullSafe(plan["__mix_source"])
    same = same & (mine["__copy"] == plan["__mix_copy"])
    ready = mine.join(plan, same).select(*[mine[c] for c in docs.columns], *[f"__mix_{c}" for c in _PLAN])

    def cut(held: dict[str, list]) -> dict[str, list]:
        made = [_taken_text(*row) for row in zip(held[text], *(held[f"__mix_{c}"] for c in _PLAN))]
        return {c: held[c] for c in docs_columns} | {text: made}

    docs_columns = list(docs.columns)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_chunks(ready, ready.columns, text, cut, ddl)
