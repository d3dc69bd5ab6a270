"""Near-duplicate groups by chosen-path set similarity join over word shingles.

Texts with equal shingle sets are one class, whatever their keys. Each class has a number and a signature of minwise tokens. A tree branches the
classes recursively: at a node, a seeded draw (the same for all its members) chooses signature places with
probability ``1 / (threshold * places)`` each, and members part by the token they have there; similar sets stay
together on some path with a chance that one tree keeps low and independent trees raise to the target recall.
Nodes of up to ``small`` classes are compared exhaustively by signature; larger ones branch on, several levels at
once, since only the last level is compared, but no deeper than the level that the number of trees counts on.

A node gives a maximum spanning forest of its likely pairs, so the pairs are linear in its members. They are
confirmed on the full shingle sets and joined into components. Large nodes first give the forests of seeded parts: one
that these links settle, with few members outside one component, goes no deeper, and the settled nodes of a component are
merged. At the end the nodes are read again, and every likely pair that still lies across components is compared within
its node on shingle hashes, none left out, and what is similar there is confirmed too; a node that is settled, or still
large at the last level, is compared so as a whole, block against block in nodes of about
``small``. Level tables are written to the shared folder; keys of hot nodes are only counted and joined, and a node is
gathered only once it is small.

Up to the last step all work is on classes (``doc`` is a class's number); rows are named by key and text hash, so
null and repeated keys stay apart, and only texts of classes in a likely pair are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, discard, in_chunks, materialize
from millrace.llm.hashing import Runs, mix

_NULL_KEY = (1 << 63) - 1
PLACES = 128
_CHARS = 1_000_000
#: Shingles that a task keeps of texts it has just compared.
_HELD = 300_000


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` with nulls after all others, ``tag`` that tells the texts of a key apart, ``text`` with null as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("key"), F.xxhash64(body).alias("tag"), body.alias("text"))


def _shingles(runs: Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes text by text, and where each text's begin; a short text's whole sequence is one shingle."""
    counts = np.diff(runs.first)
    place, _ = runs.starts(k)
    room = np.where(counts >= k, counts - k + 1, np.where(counts > 0, 1, 0))
    first = np.concatenate([[0], np.cumsum(room)])
    out = np.empty(first[-1], dtype=np.uint64)
    long = np.repeat(counts >= k, room)
    out[long] = runs.grams(k)[place]
    brief = np.flatnonzero((counts > 0) & (counts < k))
    out[first[brief]] = runs.spans(runs.first[brief], counts[brief])
    return out, first


def signatures(docs: DataFrame, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, tag, n_shingles, two hashes of the shingle set, signature (32 bits and 8 bits a place)."""
    schema = "key long, tag long, n_shingles long, h1 long, h2 long, signature binary, brief binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in in_chunks(texts, _CHARS):
                hashes, first = _shingles(Runs([t.encode().lower().split() for t in texts[a:b]]), shingle)
                size = np.diff(first)
                owner = np.repeat(np.arange(b - a), size)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[new], owner[new]
                n = np.bincount(owner, minlength=b - a)
                held = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[held]
                h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                least = np.zeros((b - a, PLACES), dtype=np.uint32)
                if len(held):
                    h1[held] = np.add.reduceat(mix(hashes), at)
                    h2[held] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for p in range(PLACES):
                        least[held, p] = (np.minimum.reduceat(hashes * by[p], at) >> np.uint64(32)).astype(np.uint32)
                raw, small = least.tobytes(), mix(least.astype(np.uint64)).astype(np.uint8).tobytes()
                columns = {
                    "key": batch.column(0).slice(a, b - a),
                    "tag": batch.column(1).slice(a, b - a),
                    "n_shingles": n,
                    "h1": h1.view(np.int64),
                    "h2": h2.view(np.int64),
                    "signature": [raw[i * PLACES * 4 : (i + 1) * PLACES * 4] for i in range(b - a)],
                    "brief": [small[i * PLACES : (i + 1) * PLACES] for i in range(b - a)],
                }
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in ("key", "tag") else pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return _rows(docs, key, text).mapInArrow(run, schema)


def trees_for(recall: float, threshold: float, depth: int) -> int:
    """Trees until a pair at the threshold is met with the wanted chance: one tree keeps it to level k with 1 / (k + 1) at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - 1 / (depth + 1)))


def _branch(nodes: DataFrame, threshold: float, trees: int = 0) -> DataFrame:
    """Descendants ``levels`` down of (path, levels, doc, signature) rows; with ``trees``, the roots' children of (doc, signature) rows."""
    schema = "path long, doc long"
    arrow = arrow_schema(nodes.sparkSession, schema)
    below = np.uint64(int(2.0**64 / (threshold * PLACES)) - 1)
    place = np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)

    def children(path: np.ndarray, row: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``path`` and ``row`` (of the signature) of all children."""
        at, p = np.nonzero(mix(path[:, None] ^ mix(place)[None, :]) < below)
        token = signature[row[at], p].astype(np.uint64) + np.uint64(1)
        return mix(mix(path[at] + place[p]) ^ token * np.uint64(0x2545F4914F6CDD1D)), row[at]

    def made(path: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(doc, pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47))
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint32).reshape(part.num_rows, PLACES)
                doc, row = part.column("doc").to_numpy(), np.arange(part.num_rows)
                for root in roots:
                    path, kept = children(np.full(len(row), root, dtype=np.uint64), row, signature)
                    yield made(path, doc[kept])
                if trees:
                    continue
                levels = part.column("levels").to_numpy()
                for n in np.unique(levels):
                    kept = row[levels == n]
                    path = part.column("path").to_numpy().view(np.uint64)[kept]
                    for _ in range(int(n)):
                        path, kept = children(path, kept, signature)
                    yield made(path, doc[kept])

    return nodes.select(*([] if trees else ["path", "levels"]), "doc", "signature").mapInArrow(run, schema)


def _parts(large: DataFrame, small: int, name: str) -> DataFrame:
    """A written table (path, doc) of large nodes (path, doc, n) dealt into seeded parts of about half of ``small``.

    About eight members of a node, drawn by hash, are members of all its parts: enough to join most near copies at
    little cost.
    """
    parts = F.ceil(2 * F.col("n") / small)
    common = F.pmod(F.xxhash64("doc", "path"), F.ceil(F.col("n") / 8)) == 0
    own = F.when(common, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("path", "doc"), parts)))
    dealt = large.select("path", "doc", F.explode(own).alias("part"))
    return materialize(dealt.select(F.xxhash64("path", "part").alias("path"), "doc"), name)


def root_nodes(classes: DataFrame, threshold: float, trees: int, small: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of the roots' children: nodes (path, doc) of 2 to ``small`` classes, and larger nodes (path, doc, n).

    Of small nodes with the same members, as near copies have in most trees, one stays.
    """
    level = materialize(_branch(classes, threshold, trees), "paths-1")
    sizes = _sizes(level, "sizes-1")
    nodes = materialize(_distinct_nodes(level, sizes.where(F.col("n") <= small)), "nodes-1")
    large = materialize(level.join(sizes.where(F.col("n") > small).select("path", "n"), "path"), "large-1")
    discard(level, sizes)
    return nodes, large


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "doc", "left").select("path", "doc", F.coalesce("label", "doc").alias("label"))


def _judged(large: DataFrame, labels: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of large nodes: members by component (path, label, m), and (path, n, main, settled).

    ``main`` is the label of a node's largest component. A node is settled where at most ``small / 2`` members lie
    outside it: comparing them with all is linear in the node, so it goes no deeper.
    """
    counts = materialize(_labelled(large, labels).groupBy("path", "label").agg(F.count(F.lit(1)).alias("m")), "node-components")
    sizes = counts.groupBy("path").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("most"))
    settled = 2 * (F.col("n") - F.col("most.m")) <= small
    return counts, materialize(sizes.select("path", "n", F.col("most.label").alias("main"), settled.alias("settled")), "judged")


def _merged(large: DataFrame, labels: DataFrame, counts: DataFrame, judged: DataFrame) -> DataFrame:
    """(path, doc): the settled nodes of one main component as one node, which holds every pair of theirs.

    Members of the main component are met by their label, the few others by node and label.
    """
    settled = judged.where("settled").select("path", "main")
    members = _labelled(large, labels)
    inner = members.join(settled, "path", "left_semi").select("doc", "label").distinct()
    inner = inner.join(settled.select(F.col("main").alias("label")).distinct(), "label").select(F.col("label").alias("main"), "doc")
    others = materialize(counts.join(settled, "path").where("label <> main").select("path", "label", "main"), "outsiders")
    others = members.join(others, ["path", "label"]).select("main", "doc")
    return inner.unionByName(others).select(F.xxhash64(F.lit("component"), "main").alias("path"), "doc").distinct()


def _descended(deeper: DataFrame, classes: DataFrame, threshold: float, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (path, doc) of the last level below (path, doc, n): nodes of 2 to ``small`` classes, and larger nodes.

    A node goes down in one step as many levels as should make it small at the similarity of typical near copies, to
    level ``depth`` at most. Of nodes with the same members one stays.
    """
    down = F.ceil(F.log(F.col("n") / small) / math.log(1.5))
    deeper = deeper.withColumn("levels", F.least(F.greatest(down, F.lit(1)), F.lit(depth - 1)).cast("int"))
    below = deeper.join(classes.select("doc", "signature").hint("merge"), "doc").select("path", "levels", "doc", "signature")
    below = materialize(_branch(below, threshold), "paths-2")
    sizes = _sizes(below, "sizes-2")
    nodes = materialize(_distinct_nodes(below, sizes.where(F.col("n") <= small)), "nodes-2")
    large = materialize(_distinct_nodes(below, sizes.where(F.col("n") > small)), "large-2")
    discard(below, sizes)
    return nodes, large


def _sizes(level: DataFrame, name: str) -> DataFrame:
    """A written table of a level's nodes of 2 classes or more: path, n, and two hashes of the set of members.

    Written before it is joined: a join of two plain exchanges can be split where a path is hot, one with an aggregate
    cannot.
    """
    held = [F.bit_xor(F.xxhash64(F.lit(i), "doc")).alias(f"set{i}") for i in (1, 2)]
    return materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *held).where("n > 1"), name)


def _distinct_nodes(level: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, doc) of the nodes in ``sizes``, one path for each set of members: the same set gives the same pairs."""
    one = sizes.groupBy("n", "set1", "set2").agg(F.min("path").alias("path")).select("path")
    return level.join(materialize(one, "distinct-nodes"), "path", "left_semi")


def crossing_blocks(large: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """(path, doc) of nodes of about ``small`` in which every pair of a large node that lies across components meets.

    A node's largest component and its other members are dealt into seeded blocks of about half that size; every block
    of the others meets every other block. Nodes of one component give nothing.
    """
    held = large.join(labels, "doc", "left").select("path", "doc", F.coalesce("label", "doc").alias("label"))
    counts = held.groupBy("path", "label").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("path").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("main"))
    main = main.where("n > main.m").select("path", "n", F.col("main.m").alias("m"), F.col("main.label").alias("main"))
    blocks = lambda n: F.ceil(2 * n / small).cast("int")
    held = held.join(main, "path").select("path", "doc", (F.col("label") == F.col("main")).alias("inner"), blocks(F.col("n") - F.col("m")).alias("others"), blocks(F.col("m")).alias("inners"))
    held = held.withColumn("own", F.pmod(F.xxhash64("doc", "path"), F.when(F.col("inner"), F.col("inners")).otherwise(F.col("others"))).cast("int"))
    meets = lambda n: F.sequence(F.lit(0), n - 1)
    pair = lambda kind, a, b: F.xxhash64("path", F.lit(kind), a, b)
    with_inner = F.transform(meets(F.col("inners")), lambda k: pair("inner", F.col("own"), k))
    with_others = F.transform(meets(F.col("others")), lambda k: pair("others", F.least("own", k), F.greatest("own", k)))
    of_inner = F.transform(meets(F.col("others")), lambda k: pair("inner", k, F.col("own")))
    paths = F.when(F.col("inner"), of_inner).otherwise(F.concat(with_inner, with_others))
    return held.select(F.explode(paths).alias("path"), "doc")


def _similar(brief: np.ndarray, i: int) -> np.ndarray:
    """Estimated similarity of one class to all, chance agreement of 8 bits taken off."""
    share = (brief == brief[i]).sum(axis=1) / PLACES
    return (share - 1 / 256) / (1 - 1 / 256)


def _oriented(x: np.int64, y: np.int64) -> tuple[np.int64, np.int64]:
    """The pair with the class of higher priority, which is likely a hub, last: texts travel by the first."""
    by = mix(np.array([x, y]).view(np.uint64))
    return (x, y) if by[0] <= by[1] else (y, x)


def _forest(docs: np.ndarray, brief: np.ndarray, least: float, sure: float) -> list[tuple[int, int]]:
    """A maximum spanning forest of a node's likely pairs.

    Sure links count alike and go to the class of highest priority, so different nodes choose the same hubs.
    """
    n, out = len(docs), []
    rank = mix(docs.view(np.uint64)).astype(np.float64) / 2.0**64
    best, link, todo = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    best[int(rank.argmax())] = least / 2
    for _ in range(n):
        i = int(np.where(todo, best, -2.0).argmax())
        if best[i] >= least:
            out.append((i, int(link[i])))
        todo[i] = False
        if not todo.any():
            break
        s = _similar(brief, i)
        s = np.where(s >= sure, 1 + rank[i], s)
        better = todo & (s > best)
        best[better], link[better] = s[better], i
    return [_oriented(docs[i], docs[j]) for i, j in out if docs[i] != docs[j]]


def _across(brief: np.ndarray, label: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Members with the later members of other labels that are likely similar to them."""
    for i in range(len(label) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if len(other):
            share = (brief[other] == brief[i]).sum(axis=1) / PLACES
            other = other[(share - 1 / 256) / (1 - 1 / 256) >= least]
            if len(other):
                yield i, other


def _by_node(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(path, columns)`` over the rows of every node, which come one after another; it yields result columns."""
    names = [c for c in rows.columns if c != "path"]
    arrow = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path = [], None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            made = each(path, {c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in names})
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, arrow)], schema=arrow)

        for batch in batches:
            paths = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(paths)) + 1), len(paths)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and paths[a] != path:
                    yield from done()
                    held = []
                path = paths[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return rows.select("path", *names).repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)


def _briefs(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), PLACES)


def _forest_pairs(nodes: DataFrame, classes: DataFrame, least: float, sure: float) -> DataFrame:
    """Distinct pairs of all nodes' forests."""

    def each(path: int, held: dict) -> tuple:
        return tuple(zip(*sorted(set(_forest(held["doc"], _briefs(held["brief"]), least, sure))))) or ((), ())

    return _by_node(nodes.join(classes.select("doc", "brief"), "doc"), each, "a long, b long").distinct()


def _open_ends(nodes: DataFrame, classes: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """A written table of the members of nodes with a likely partner of another component: path, doc, label.

    Of nodes with the same such members one stays.
    """
    labelled = nodes.join(classes.select("doc", "brief"), "doc").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))

    def mark(path: int, held: dict) -> tuple:
        found: set[int] = set()
        if (held["label"] != held["label"][0]).any():
            for i, other in _across(_briefs(held["brief"]), held["label"], least):
                found.update((i, *other.tolist()))
        at = np.array(sorted(found), dtype=np.int64)
        return np.full(len(at), path), held["doc"][at], held["label"][at]

    every = materialize(_by_node(labelled, mark, "path long, doc long, label long"), "every-open-end")
    sizes = _sizes(every, "open-sizes")
    ends = materialize(_distinct_nodes(every, sizes), "open-ends")
    discard(every, sizes)
    return ends


def _links_across(open_ends: DataFrame, classes: DataFrame, texts: DataFrame, least: float, percent: int, shingle: int) -> DataFrame:
    """Distinct pairs of a node's open ends that lie across components and whose shingle hashes are similar enough.

    Only open ends carry their shingle hashes to the nodes, where their likely pairs are compared, so what comes out
    is links and not candidates.
    """
    sets = materialize(_hash_sets(texts.join(open_ends.select("doc").distinct(), "doc", "left_semi"), shingle), "open-sets").hint("merge")

    def compare(path: int, held: dict) -> tuple:
        out = set()
        hashes = [np.frombuffer(x, dtype=np.uint64) for x in held["hashes"]]
        for i, other in _across(_briefs(held["brief"]), held["label"], least):
            for j in other.tolist():
                both = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
                if 100 * both >= percent * (len(hashes[i]) + len(hashes[j]) - both):
                    out.add(_oriented(held["doc"][i], held["doc"][j]))
        return tuple(zip(*sorted(out))) or ((), ())

    carried = open_ends.join(classes.select("doc", "brief"), "doc").join(sets, "doc")
    return materialize(_by_node(carried, compare, "a long, b long").distinct(), "links-across")


class _Texts:
    """Written tables (doc, text) of the classes asked for so far, each by the text of the row that names it."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes, self.held = rows, classes, []

    def of(self, wanted: DataFrame) -> DataFrame:
        """A table with at least the texts of the wanted classes (doc)."""
        for table in self.held:
            wanted = wanted.join(table.select("doc"), "doc", "left_anti")
        named = materialize(self.classes.select("doc", "key", "tag").join(wanted.distinct(), "doc", "left_semi"), "wanted")
        if not self.held or not named.isEmpty():
            # never broadcast: the classes asked for grow with the data; copies of a row fall together on the map side
            texts = self.rows.join(named.hint("merge"), ["key", "tag"]).groupBy("doc").agg(F.first("text").alias("text"))
            self.held.append(materialize(texts, "texts"))
        discard(named)
        return reduce(DataFrame.unionByName, self.held)


def _across_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends no links join yet."""
    of = lambda end: labels.select(F.col("doc").alias(end), F.col("label").alias(f"{end}_label"))
    ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return ends.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def _hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc, sorted distinct shingle hashes) of given texts."""
    schema = "doc long, hashes binary"
    arrow = arrow_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            for a, b in in_chunks(held, _CHARS):
                hashes, first = _shingles(Runs([t.encode().lower().split() for t in held[a:b]]), shingle)
                made = [np.unique(hashes[first[i] : first[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.binary())], schema=arrow)

    return texts.select("doc", "text").mapInArrow(run, schema)


def shingle_set(text: str, k: int = 5) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else set(zip(*(words[i:] for i in range(k))))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        room = _HELD

        def of(doc: int, text: pa.StringScalar) -> set:
            nonlocal room
            if doc not in held:
                made = shingle_set(text.as_py(), shingle)
                if len(made) > room:
                    held.clear()
                    room = _HELD
                held[doc] = made
                room -= len(made)
            return held[doc]

        for batch in batches:
            keep = []
            for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = of(a, s), of(b, t)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    # never broadcast: the texts have no size bound
    first = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("s")).hint("merge"), "a")
    both = first.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("t")).hint("merge"), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _roots(parents: DataFrame, rounds: int) -> DataFrame:
    """(doc, label) with every label followed to one that is its own, by pointer jumps."""
    for _ in range(rounds):
        above = parents.select(F.col("doc").alias("label"), F.col("label").alias("further"))
        jumped = materialize(parents.join(above, "label").select("doc", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "jumped")
        parents = jumped.select("doc", "label")
        if jumped.where("moved").isEmpty():
            break
    return parents


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(doc, label) of all ends of links: the least doc each reaches.

    Every doc hooks to its least neighbour, trees are followed to their roots, and links between roots go around
    again; links within a tree drop out, so later rounds see few rows.
    """
    links = materialize(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    labels = None
    for _ in range(rounds):
        ends = links.select(F.col("high").alias("doc"), F.col("low").alias("label")).unionByName(links.select(F.col("low").alias("doc"), F.col("low").alias("label")))
        roots = materialize(_roots(ends.groupBy("doc").agg(F.min("label").alias("label")), rounds), "roots")
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("doc").alias("label"), F.col("label").alias("further"))
            labels = materialize(labels.join(further, "label", "left").select("doc", F.coalesce("further", "label").alias("label")), "labels")
        low, high = (roots.select(F.col("doc").alias(c), F.col("label").alias(f"{c}_root")) for c in ("low", "high"))
        again = links.join(low, "low").join(high, "high").where("low_root <> high_root")
        again = again.select(F.least("low_root", "high_root").alias("low"), F.greatest("low_root", "high_root").alias("high")).distinct()
        links = materialize(again, "links")
        if links.isEmpty():
            break
    return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: the components themselves are linked, so only few rows go around again."""
    of = lambda end: labels.select(F.col("doc").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    known = labels.join(over.select(F.col("doc").alias("label"), F.col("label").alias("further")), "label", "left")
    known = known.select("doc", F.coalesce("further", "label").alias("label"))
    return known.unionByName(over.join(known.select("doc"), "doc", "left_anti"))


def _named_rows(
    docs: DataFrame, shingle: int, percent: int, key: str, text: str, recall: float, small: int, depth: int, margin: float
) -> DataFrame:
    """Per row of ``docs``: key, tag, n_shingles, and least_key and least_tag, those of the least row that links reach."""
    threshold = percent / 100
    signed = materialize(signatures(docs, shingle, key, text), "signatures")
    held = signed.where("n_shingles > 0")
    classes = held.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("key", "tag", "signature", "brief")).alias("x"))
    # numbered when written: reading the table again gives the same numbers
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("doc"), "h1", "h2", "n_shingles", "x.*"), "classes")
    slim = materialize(signed.select("key", "tag", "n_shingles", "h1", "h2"), "rows")
    discard(signed)
    least, sure = threshold - margin, threshold + margin
    texts = _Texts(_rows(docs, key, text), classes)

    def linked(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Labels after the links of the nodes' forests."""
        pairs = _forest_pairs(nodes, classes, least, sure)
        pairs = materialize(pairs if labels is None else _across_components(pairs, labels), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
        links = materialize(_confirmed(pairs, texts.of(ends), percent, shingle), "confirmed")
        out = components(links) if labels is None else materialize(_joined(labels, links), "labels")
        discard(pairs, links)
        return out

    nodes, large = root_nodes(classes, threshold, trees_for(recall, threshold, depth), small)
    parts = _parts(large, small, "parts-1")
    labels = linked(nodes.unionByName(parts), None)
    counts, judged = _judged(large, labels, small)
    deeper = materialize(large.join(judged.where("not settled"), "path", "left_semi"), "deeper")
    whole = materialize(_merged(large, labels, counts, judged), "merged-1")
    below, still_large = _descended(deeper, classes, threshold, small, depth)
    discard(parts, deeper, counts, judged, large)
    if not (below.isEmpty() and still_large.isEmpty()):
        counts, judged = _judged(still_large, labels, small)
        mixed = materialize(still_large.join(judged.where("not settled").select("path", "n"), "path"), "mixed")
        merged = materialize(_merged(still_large, labels, counts, judged), "merged-2")
        parts = _parts(mixed, small, "parts-2")
        labels = linked(below.unionByName(parts), labels)
        whole = whole.unionByName(merged).distinct().unionByName(mixed.select("path", "doc"))
        discard(parts, counts, judged)
    whole = materialize(whole, "whole-nodes")
    discard(still_large)
    crossing = materialize(crossing_blocks(whole, labels, small), "crossing-blocks")
    ends = _open_ends(nodes.unionByName(below).unionByName(crossing), classes, labels, least)
    if not ends.isEmpty():
        held = texts.of(ends.select("doc"))
        across = _links_across(ends, classes, held, least, percent, shingle)
        more = materialize(_confirmed(across, held, percent, shingle), "confirmed-across")
        if not more.isEmpty():
            labels = materialize(_joined(labels, more), "labels")
    discard(nodes, below, whole, crossing, ends, *texts.held)

    owned = classes.select("doc", "key", "tag", "h1", "h2", "n_shingles").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    roots = materialize(owned.groupBy("label").agg(F.min(F.struct("key", "tag")).alias("least")), "roots")
    named = materialize(owned.join(roots, "label").select("h1", "h2", "n_shingles", F.col("least.key").alias("least_key"), F.col("least.tag").alias("least_tag")), "named-classes")
    discard(classes)
    out = slim.join(named, ["h1", "h2", "n_shingles"], "left")
    return out.select("key", "tag", "n_shingles", F.coalesce("least_key", "key").alias("least_key"), F.coalesce("least_tag", "tag").alias("least_tag"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
    recall: float = 0.97,
    small: int = 1000,
    depth: int = 6,
    margin: float = 0.1,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Links join texts whose shingle sets have ``100 * intersection >= percent * union``, confirmed on the full sets.
    A text with fewer words than a shingle is one shingle of them all; a null or empty text has none and no links.
    Every row stands for itself, so rows that share a doc_id, null too, are linked by their texts alone. A null
    doc_id is larger than all others: it reads null as a component only where no linked row has an id.
    ``kept`` is whether doc_id and component_id are equal, nulls too. ``margin`` is how far below the threshold a
    pair's estimate may lie and still be confirmed.
    """
    rows = _named_rows(docs, shingle, percent, key, text, recall, small, depth, margin)
    clean = lambda c: F.when(F.col(c) != _NULL_KEY, F.col(c))
    return rows.select(
        clean("key").alias("doc_id"), "n_shingles", clean("least_key").alias("component_id"), (F.col("key") == F.col("least_key")).alias("kept")
    )


def keep_one(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    recall: float = 0.97,
    small: int = 1000,
    depth: int = 6,
    margin: float = 0.1,
) -> DataFrame:
    """One row of each group of ``docs``: of the rows that links join, the one with the least key, then text hash.

    A null key is larger than all others. Of rows with equal key and text one stays, empty texts too, chosen by the
    other columns; rows without words are linked with nothing else.
    """
    rows = _named_rows(docs, shingle, percent, key, text, recall, small, depth, margin)
    gone = rows.where("key <> least_key or tag <> least_tag").select("key", "tag").distinct()
    gone = materialize(gone.select(F.col("key").alias("__key"), F.col("tag").alias("__tag")), "gone")
    body, rank = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY))
    # the limit of one row a (key, tag) acts before the shuffle, so copies of a row do not travel
    first = Window.partitionBy("__row_key", "__row_tag").orderBy(F.xxhash64(*docs.columns))
    one = docs.withColumns({"__row_key": rank, "__row_tag": F.xxhash64(body)}).withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    same = (F.col("__row_key") == F.col("__key")) & (F.col("__row_tag") == F.col("__tag"))
    return one.join(gone, same, "left_anti").select(*docs.columns)
