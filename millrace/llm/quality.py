"""Quality rules as a short-circuit cascade.

Every rule's cost (seconds a document) and selectivity (share of documents it rejects) are estimated on a
sample of rows; the rules then run in the order of rejections per cost, where a rule's rejections are those among the
documents that the rules before it keep, and a document that one rejects skips the rest.
A document is kept if no rule rejects it, so the order changes the time and never the verdict.

The sample is measured on the executors, inside one narrow pass, and comes back as one row for each set of rules that
reject a document together; only the order depends on it. Its expected number of rows (``sample_rows``) is the documented bound.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_chunks

#: Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Document:
    """A text with what rules share, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._held: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def parsed(self) -> Document:
        """A new document of the same text that has its words already and nothing else."""
        other = Document(self.text)
        other._held.update(data=self.data, words=self.words)
        return other

    @property
    def data(self) -> bytes:
        return self._once("data", self.text.encode)

    @property
    def words(self) -> list[bytes]:
        return self._once("words", self.data.split)

    @property
    def word_chars(self) -> int:
        space = sum(self.data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        return len(self.text) - space

    @property
    def n_symbols(self) -> int:
        return self._once("symbols", lambda: sum(self.data.count(c) for c in map(str.encode, SYMBOLS)))

    @property
    def lines(self) -> list[bytes]:
        return self._once("lines", lambda: [x for x in self.data.split(b"\n") if x and not x.isspace()])

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def word_ids(self) -> np.ndarray:
        def make() -> np.ndarray:
            seen: dict[bytes, int] = {}
            return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.int64, count=len(self.words))

        return self._once("ids", make)

    @property
    def n_repeat_words(self) -> int:
        """Words in windows of five words that stand in the text twice or more.

        Window ids come from pairs of ids, made dense after each step, so equal ids are equal windows.
        """

        def make() -> int:
            ids = self.word_ids
            n = len(ids)
            if n <= WINDOW or len(np.unique(ids)) == n:
                return 0
            grams, width = ids, 1
            while width < WINDOW:
                more = min(width, WINDOW - width)
                left, right = grams[: n - width - more + 1], grams[more : more + n - width - more + 1]
                pairs = left * (int(grams.max()) + 1) + right
                _, grams = np.unique(pairs, return_inverse=True)
                width += more
            hits = np.bincount(grams)[grams] > 1
            covered = np.zeros(n + 1, dtype=np.int64)
            starts = np.flatnonzero(hits)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + WINDOW, -1)
            return int((np.cumsum(covered[:n]) > 0).sum())

        return self._once("repeats", make)


@dataclass(frozen=True)
class Rule:
    """``rejects(document)``; ``name`` names it in traces."""

    name: str
    rejects: Callable[[Document], bool]


def _few_words(d: Document) -> bool:
    return len(d.words) < 10


def _repeats(d: Document) -> bool:
    return 100 * d.n_repeat_words > 20 * len(d.words)


def _symbols(d: Document) -> bool:
    return 10 * d.n_symbols > len(d.words)


def _duplicate_lines(d: Document) -> bool:
    return 2 * d.n_dup_lines > len(d.lines)


def _word_length(d: Document) -> bool:
    return not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words)


def _stutter(d: Document) -> bool:
    """Over three tenths of the words equal the word before."""
    ids = d.word_ids
    return len(ids) > 1 and 10 * int((ids[1:] == ids[:-1]).sum()) > 3 * len(ids)


def _shouting(d: Document) -> bool:
    """Over half of the words in upper case alone, of two letters at least."""
    return 2 * sum(1 for w in d.words if len(w) > 1 and w.isupper()) > len(d.words)


#: Public heuristics for web text: shares of symbols, repeats and lines, word length.
RULES = (
    Rule("few_words", _few_words),
    Rule("repeats", _repeats),
    Rule("symbols", _symbols),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("word_length", _word_length),
    Rule("stutter", _stutter),
    Rule("shouting", _shouting),
)


#: What is computed for every document anyway.
BASE = RULES[:2]


def _outcomes(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...], text: str, sample_rows: int, seed: int) -> DataFrame:
    """Per set of rules (``mask``) that reject a document: documents ``n``, and seconds of every rule on them (``s0``, ...)."""
    total = docs.select().count()  # no column is read
    share = min(1.0, sample_rows / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 40)) < int(share * (1 << 40)) + 1
    picked = docs.select(text).where(drawn)
    spent = [f"s{i}" for i in range(len(rules))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[float]] = {}
        for batch in batches:
            for body in batch.column(0):
                read = Document(body.as_py())
                if any(rule.rejects(read) for rule in base):
                    continue
                mask, seconds = 0, []
                for i, rule in enumerate(rules):
                    document = read.parsed()
                    began = time.perf_counter()
                    mask |= bool(rule.rejects(document)) << i
                    seconds.append(time.perf_counter() - began)
                row = held.setdefault(mask, [0.0] * (len(rules) + 1))
                for i, x in enumerate([1.0, *seconds]):
                    row[i] += x
        columns = [pa.array(list(held), pa.int64()), pa.array([int(r[0]) for r in held.values()], pa.int64())]
        columns += [pa.array([r[i + 1] for r in held.values()], pa.float64()) for i in range(len(rules))]
        yield pa.RecordBatch.from_arrays(columns, names=["mask", "n", *spent])

    each = picked.mapInArrow(run, "mask long, n long" + "".join(f", {c} double" for c in spent))
    return each.groupBy("mask").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in spent])


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 11, base: tuple[Rule, ...] = ()) -> DataFrame:
    """One row per rule: documents tried, rejected, and seconds, on a sample of about ``sample_rows`` rows.

    Rows are drawn one by one by the hash of their place in the scan, so equal texts do not come or go together. The
    words are split once for all rules, since any of them needs that; beyond it each rule is timed with a document of
    its own. Documents that a rule of ``base`` rejects are not tried.
    """
    if not rules:
        return docs.sparkSession.createDataFrame([], "rule string, tried long, rejected long, seconds double")
    bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1))
    one = [F.struct(F.lit(r.name).alias("rule"), F.col("n").alias("tried"), (F.col("n") * bit(i)).alias("rejected"), F.col(f"s{i}").alias("seconds")) for i, r in enumerate(rules)]
    each = _outcomes(docs, rules, base, text, sample_rows, seed).select(F.inline(F.array(*one)))
    return each.groupBy("rule").agg(F.sum("tried").alias("tried"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 11, base: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The rules, each in turn the one that rejects most per second of what those before it (and ``base``) keep; ties as given."""
    if not rules:
        return ()
    rows = _outcomes(docs, rules, base, text, sample_rows, seed).collect()  # at most as many as the sample has
    cost = [max(sum(r[f"s{i}"] for r in rows), 1e-9) for i in range(len(rules))]
    todo, ordered = list(range(len(rules))), []
    while todo:
        best = max(todo, key=lambda i: sum(r["n"] for r in rows if r["mask"] >> i & 1) / cost[i])
        todo.remove(best)
        ordered.append(rules[best])
        rows = [r for r in rows if not r["mask"] >> best & 1]
    return tuple(ordered)


def judge(document: Document, rules: tuple[Rule, ...]) -> str | None:
    """The first rule in order that rejects the document."""
    return next((r.name for r in rules if r.rejects(document)), None)


def score_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Per row of ``docs``: the base counts over its whole text, whether those fail, and the cascade's verdict.

    A null or empty text has no words and fails. Repeated rows each give a row. The base is computed for every text, so
    the cascade orders and runs the other rules, by what they reject of the documents that pass it.
    """
    ordered = cascade_order(docs, tuple(r for r in rules if r not in BASE), text, sample_rows, base=BASE)

    def run(held: dict[str, list]) -> dict[str, list]:
        rows = []
        for key_, text_ in zip(held["doc_id"], held["text"]):
            d = Document(text_)
            failed = _few_words(d) or _repeats(d)
            kept = not failed and judge(d, ordered) is None
            rows.append((key_, len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
        return dict(zip(("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), zip(*rows)))

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_chunks(rows, ["doc_id", "text"], "text", run, schema)


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; here a rejected text skips the rules left."""
    ordered = cascade_order(docs, rules, text, sample_rows)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(Document(t.as_py()), ordered) is None for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.select(*[docs[c] for c in names]).mapInArrow(run, docs.schema)
