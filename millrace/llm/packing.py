"""Packing documents into windows by non-negative least squares over length combinations.

Documents are cut at whole windows; what is left of each falls into a length class (multiples of ``window / 64``).
Shallow combinations of classes that fill a window are enumerated once; their repeat counts are solved by
non-negative least squares against the histogram of classes, rounded down, and dealt to the documents. Documents
that no count covers are the residual: they are cut greedily to fill the gaps of the dealt windows, then windows of
their own; the last stretch becomes windows of power-of-two lengths, which need no padding.

Each task packs its own rows in blocks of up to ``block_tokens`` ids with a histogram of their own, so nothing is
shuffled, memory is bounded, and a lost executor's tasks repeat alone.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import arrow_schema, in_chunks
from millrace.llm.tokens import encoder

CLASSES = 64


@lru_cache(maxsize=1)
def combinations() -> np.ndarray:
    """Columns: how often each class (1 to 64 units) stands in a combination that fills 64 units.

    Any repeats of one or two classes, and three different classes once each.
    """
    found: set[tuple[tuple[int, int], ...]] = set()
    for a in range(1, CLASSES + 1):
        for i in range(1, CLASSES // a + 1):
            rest = CLASSES - a * i
            if rest == 0:
                found.add(((a, i),))
            for b in range(1, min(a, rest + 1)):
                if rest % b == 0:
                    found.add(((a, i), (b, rest // b)))
    for a in range(1, CLASSES):
        for b in range(1, a):
            c = CLASSES - a - b
            if 0 < c < b:
                found.add(((a, 1), (b, 1), (c, 1)))
    out = np.zeros((CLASSES, len(found)))
    for j, combination in enumerate(sorted(found)):
        for a, i in combination:
            out[a - 1, j] = i
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least ``|a x - b|``, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, inside, small = np.zeros(n), np.zeros(n, dtype=bool), 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    slope = a.T @ b
    for _ in range(rounds):
        outside = np.where(inside, -np.inf, slope)
        j = int(outside.argmax())
        if outside[j] <= small * 10:
            break
        inside[j] = True
        while True:
            held = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, held], b, rcond=None)[0]
            if s.min(initial=1.0) > 0:
                x = np.zeros(n)
                x[held] = s
                break
            low = s <= 0
            step = np.min(x[held][low] / np.maximum(x[held][low] - s[low], 1e-300))
            x[held] += step * (s - x[held])
            inside[held[x[held] <= small]] = False
            x[~inside] = 0
            if not inside.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def pack(lengths: list[int], window: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths, each id in one piece."""
    pieces, sequences = [], 0
    unit = window / CLASSES
    classes: dict[int, list[int]] = defaultdict(list)
    left = {}
    for d, n in enumerate(lengths):
        for k in range(n // window):
            pieces.append((d, k * window, window, sequences, 0))
            sequences += 1
        if n % window:
            left[d] = n % window
            classes[int(-(-(n % window) // unit))].append(d)
    for held in classes.values():
        held.sort(key=lambda d: (left[d], -d))
    histogram = np.array([len(classes.get(c, ())) for c in range(1, CLASSES + 1)], dtype=float)
    table = combinations()
    usable = np.flatnonzero((table[histogram == 0] == 0).all(axis=0)) if histogram.any() else []
    dealt: list[list[int]] = []
    if len(usable):
        counts = np.floor(nnls(table[:, usable], histogram) + 1e-6).astype(int)
        for j in np.argsort(-counts, kind="stable"):
            need = [(int(c) + 1, int(table[c, usable[j]])) for c in np.flatnonzero(table[:, usable[j]])]
            times = min([int(counts[j]), *(len(classes[c]) // m for c, m in need)])
            for _ in range(times):
                dealt.append([classes[c].pop() for c, m in need for _ in range(m)])
    rest = sorted((d for held in classes.values() for d in held), key=lambda d: (-left[d], d))
    spare, gaps = sum(left[d] for d in rest), [window - sum(left[d] for d in s) for s in dealt]
    missing = sum(gaps)
    while dealt and missing > spare:  # too little to fill the gaps with: the last window joins the residual
        s = dealt.pop()
        missing -= gaps.pop()
        rest += s
        spare += sum(left[d] for d in s)
    places = []
    for s, gap in zip(dealt, gaps):
        at = 0
        for d in s:
            pieces.append((d, lengths[d] - left[d], left[d], sequences, at))
            at += left[d]
        if gap:
            places.append((sequences, at, gap))
        sequences += 1
    spare -= missing
    for _ in range(spare // window):
        places.append((sequences, 0, window))
        sequences += 1
    for power in (1 << k for k in range(window.bit_length() - 1, -1, -1)):
        if spare % window & power and power < window:
            places.append((sequences, 0, power))
            sequences += 1
    todo, d, start, n = iter(rest), -1, 0, 0
    for sequence, at, room in places:
        while room:
            if not n:
                d = next(todo)
                start, n = lengths[d] - left[d], left[d]
            take = min(n, room)
            pieces.append((d, start, take, sequence, at))
            start, n, at, room = start + take, n - take, at + take, room - take
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = 4096,
    end_id: int = 2,
    block_tokens: int = 12_000_000,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` too if asked for.

    A null or empty text is the end id alone. Repeated rows are packed each for itself; null keys stay null.
    ``window`` is a power of two. Sequences are numbered within tasks, apart by the task's partition.
    """
    if window & (window - 1) or window < CLASSES:
        raise ValueError("window must be a power of two of at least 64")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end = encoder(tokenizer), struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 36
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            pieces = pack([len(x) // 4 for x in ids], window)
            views = [memoryview(x) for x in ids]
            for a in range(0, len(pieces), 20_000):
                some = pieces[a : a + 20_000]
                columns = {
                    "doc_id": [keys[p[0]] for p in some],
                    "start": [p[1] for p in some],
                    "length": [p[2] for p in some],
                    "ids_crc32": [zlib.crc32(views[p[0]][4 * p[1] : 4 * (p[1] + p[2])]) for p in some],
                    "doc_tokens": [len(ids[p[0]]) // 4 for p in some],
                    "sequence_id": [base + p[3] for p in some],
                    "offset": [p[4] for p in some],
                }
                if with_ids:
                    columns["ids"] = [np.frombuffer(views[p[0]][4 * p[1] : 4 * (p[1] + p[2])], "<i4") for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
            base += 1 + max((p[3] for p in pieces), default=0)
            keys.clear()
            ids.clear()
            held = 0

        for batch in batches:
            k, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_chunks(t):
                made = [x + end for x in words.ids(t[a:b])]
                keys += k[a:b]
                ids += made
                held += sum(map(len, made)) // 4
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def padding(pieces: list[tuple[int, int, int, int, int]], window: int = 4096) -> int:
    """Padded places: a sequence is filled up to the window, except where its length is a power of two."""
    used = Counter()
    for p in pieces:
        used[p[3]] += p[2]
    return sum(0 if n & (n - 1) == 0 else window - n for n in used.values())
