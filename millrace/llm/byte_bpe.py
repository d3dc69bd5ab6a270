"""Byte-level BPE on Spark's higher-order functions: ranked merges folded over the bytes of distinct words.

A rank map, dealt into small buckets by hash, says which adjacent pieces merge first. Ids are held as single
characters in the order of ranks, so a word is a string and a merge is a substitution in it. A text's words are looked up
as wholes, in the vocabulary and in the words of a sample, which Spark folds beforehand. Each distinct word that is not
found is folded once, and the text's words find theirs by binary search: the merges of the lowest ranks are made in all
these words at once, the others in each word, merge by merge. Both maps are scalar subqueries. Decoding concatenates the
ids' bytes. Everything else is expressions on a row; the texts are not shuffled.

The fold copies a word's pieces at every merge, so its cost is quadratic in the word. Words above ``LONGEST`` bytes,
which prose has few of, go through a heap of merges instead (the one Python function here): the same ids, near-linear.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.fill_middle import let

LONGEST = 64
_BUCKETS = 1 << 16
_WORD_BUCKETS = 1 << 19
#: Merges of the lowest ranks that are made in all words of a text at once, at most.
_AT_ONCE = 128
#: What parts words then: no character.
_PART = "\uffff"
#: More than any word has pieces.
_REST = 1_000_000
_STEPS = [1 << k for k in range(30, -1, -1)]
#: An id as one character, whose order is that of ranks; the first plane holds the surrogates, so ids start above it.
_FIRST = 0x10000
#: What a pair that nothing merges gives.
_NONE = chr(0x10FFFF)
#: White space by Unicode, as a class.
_SPACES = r"\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Begin and end of a word's entry in a bucket: code points that are no characters.
_MARKS = _BEGIN, _END = "\ufffe", "\uffff"


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are the ids, of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _place(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


def _bucket(table: Column, key: Column, buckets: int = _BUCKETS) -> Column:
    return F.get(table, _place(key, buckets))


def _find(table: Column, word: Column) -> Column:
    """Ids of a word, or an empty string: what stands behind its entry in the bucket, up to the next."""
    behind = F.call_function("substring_index", _bucket(table, word, _WORD_BUCKETS), F.concat(F.lit(_BEGIN), word, F.lit(_END)), F.lit(-1))
    return F.substring_index(behind, _BEGIN, 1)


@functools.lru_cache(maxsize=4)
def _rank_buckets(path: str) -> list[str]:
    """The rank map: two adjacent ids, as characters, to the id that their bytes make.

    A bucket is one string of entries ``ab=c;``. Two ids stand side by side in it only as a key, so a search for them
    finds their entry; where there is none, all of the bucket is left, and begins with ``=`` and ``_NONE`` as an entry's end does.
    """
    held = ranks(path)
    out = [["=", _NONE, ";"] for _ in range(_BUCKETS)]
    for token, rank in held.items():
        for cut in range(1, len(token)):
            left, right = held.get(token[:cut]), held.get(token[cut:])
            if left is not None and right is not None:
                pair = chr(_FIRST + left) + chr(_FIRST + right)
                out[zlib.crc32(pair.encode()) % _BUCKETS].append(f"{pair}={chr(_FIRST + rank)};")
    return list(map("".join, out))


def rank_map(path: str) -> Column:
    """The rank map as a literal."""
    return F.split(F.lit(",".join(_rank_buckets(path))), ",")


def _rank_value(spark: SparkSession, path: str) -> Column:
    """The rank map as a scalar subquery, which the text of a plan does not hold."""
    return spark.createDataFrame(pa.table({"t": pa.array([_rank_buckets(path)], pa.list_(pa.string()))})).scalar()


def _merged(table: Column, pair: Column) -> Column:
    """The id that two ids merge to, or ``_NONE``, which comes after all ids."""
    return F.substring(F.call_function("substring_index", _bucket(table, pair), pair, F.lit(-1)), 2, 1)


@functools.lru_cache(maxsize=4)
def first_merges(path: str, most: int = _AT_ONCE) -> list[tuple[bytes, list[tuple[bytes, bytes]]]]:
    """The merged tokens of the lowest ranks, each with the pairs that make it, as far as one may be made everywhere before the next.

    That is so where a token, once made, is in no pair of a rank up to its own, and no two pairs that make it overlap:
    then no merge brings back a lower rank, and equal ones are taken from the left, as one by one.
    """
    held = ranks(path)
    out: list[tuple[bytes, list[tuple[bytes, bytes]]]] = []
    around: dict[bytes, int] = {}  # least rank of a longer token that begins or ends with the token
    for token, rank in held.items():
        for cut in range(1, len(token)):
            for part in (token[:cut], token[cut:]):
                around[part] = min(rank, around.get(part, rank))
    for token, rank in sorted((one for one in held.items() if len(one[0]) > 1), key=lambda one: one[1])[:most]:
        pairs = [(token[:cut], token[cut:]) for cut in range(1, len(token)) if token[:cut] in held and token[cut:] in held]
        overlap = any(a[1] == b[0] for a in pairs for b in pairs if a != b)
        if overlap or around.get(token, rank + 1) <= rank:
            break
        out.append((token, pairs))
    return out


def begun(words: Column, path: str) -> Column:
    """Words as strings of ids after the merges of ``first_merges``, all made in one string of all the words."""
    held, made = ranks(path), first_merges(path)
    piece = {bytes([b]): chr(b) for b in range(256)} | {token: chr(256 + i) for i, (token, _) in enumerate(made)}
    rules = [f"{piece[a]}{piece[b]}{piece[token]}" for token, pairs in made for a, b in pairs if a in piece and b in piece]
    joined = F.array_join(F.transform(words, lambda x: F.decode(x.cast("binary"), "ISO-8859-1")), _PART)
    if rules:
        joined = F.aggregate(F.array(*map(F.lit, rules)), joined, lambda text, rule: F.replace(text, F.substring(rule, 1, 2), F.substring(rule, 3, 1)))
    return F.split(F.translate(joined, "".join(piece.values()), "".join(chr(_FIRST + held[token]) for token in piece)), _PART)


def word_map(spark: SparkSession, path: str, memo: DataFrame | None) -> Column:
    """Map of whole words to their ids, as a scalar subquery: tokens that are text, and the words of ``memo`` (w, ids, count); none with a mark of the map's own."""
    known = {}
    for token, rank in ranks(path).items():
        try:
            known[token.decode()] = chr(_FIRST + rank)
        except UnicodeDecodeError:
            continue
    words = spark.createDataFrame(pa.table({"w": list(known), "ids": list(known.values()), "count": [0] * len(known)}))
    words = words if memo is None else words.unionByName(memo)
    kept = words.where(F.translate("w", "".join(_MARKS), "") == F.col("w"))
    entries = kept.select(_place(F.col("w"), _WORD_BUCKETS).alias("b"), "count", F.concat("w", F.lit(_END), "ids", F.lit(_BEGIN)).alias("e"))
    every = spark.range(0, _WORD_BUCKETS, 1, 8).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("count"), F.lit("").alias("e"))
    # a search begins at the end of a bucket, where its most frequent word stands
    listed = F.transform(F.sort_array(F.collect_list(F.struct("count", "e"))), lambda x: x["e"])
    buckets = entries.union(every).groupBy("b").agg(F.concat(F.lit(_BEGIN), F.array_join(listed, "")).alias("s"))
    return buckets.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "s"))), lambda x: x["s"])).scalar()


def fold(word: Column, table: Column, path: str) -> Column:
    """Ids of one word, as characters: its bytes, merged pair by pair, the least rank first and the leftmost of equal ones."""
    return merge_rest(F.element_at(begun(F.array(word), path), 1), table)


def merge_rest(begun_word: Column, table: Column) -> Column:
    """Ids of a word that ``begun`` has begun.

    Beside the ids goes what each adjacent pair merges to; a merge looks up only the pairs on its two sides.
    """

    def begin(s: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: _merged(table, F.substring(s, i, F.lit(2))))
        return F.struct(s.alias("s"), F.when(F.length(s) < 2, "").otherwise(F.array_join(pairs, "")).alias("p"))

    def merge(held: Column, _: Column) -> Column:
        s, p = held["s"], held["p"]

        def least(m: Column) -> Column:
            def at(i: Column) -> Column:
                before = F.when(i > 1, _merged(table, F.concat(F.substring(s, i - 1, F.lit(1)), m))).otherwise("")
                after = F.when(i < F.length(p), _merged(table, F.concat(m, F.substring(s, i + 2, F.lit(1))))).otherwise("")
                return F.struct(
                    F.concat(F.substring(s, F.lit(1), i - 1), m, F.substring(s, i + 2, F.lit(_REST))).alias("s"),
                    F.concat(F.substring(p, F.lit(1), i - 2), before, after, F.substring(p, i + 2, F.lit(_REST))).alias("p"),
                )

            return F.when(m.isin("", _NONE), held).otherwise(let(F.instr(p, m), at))

        return let(F.array_min(F.split(p, "")), least)

    return let(begun_word, lambda s: F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(s), F.lit(2))), begin(s), merge, lambda made: made["s"]))


def merge_heap(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of (rank, place); a merge makes its neighbours' entries stale, and they are passed over."""
    ends = list(range(1, len(word) + 1))  # end of the piece that begins here
    before = list(range(-1, len(word) - 1))  # begin of the piece before the one that begins here
    alive = bytearray(b"\x01") * len(word)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < len(word):
            rank = table.get(word[i : ends[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not alive[i] or j >= len(word) or ends[j] != end:
            continue
        alive[j] = 0
        ends[i] = end
        if end < len(word):
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [table[word[i : ends[i]]] for i in range(len(word)) if alive[i]]


def _long_words(path: str):
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        made = [None if words is None else ["".join(chr(_FIRST + i) for i in merge_heap(w.encode(), ranks(path))) for w in words] for words in lists.to_pylist()]
        return pa.array(made, pa.list_(pa.string()))

    return run


@functools.lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """All letters and all numbers of the newest Unicode version at hand, as strings."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return {name: "".join(regex.findall(rf"\p{{{name}}}", every)) for name in ("L", "N")}


def known_to_library(chars: str, name: str, pattern: str) -> str:
    """Those of ``chars`` that the library's own Unicode version counts as letters (L) or numbers (N).

    Bytes merge only within one match, so a character is of the class if its first byte merges with one before it.
    """
    import tiktoken

    start, out = {"L": b"a", "N": b"1"}[name], []
    for first in sorted({c.encode()[0] for c in chars}):
        table = {bytes([b]): b for b in range(256)} | {start + bytes([first]): 256}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        out += [c for c in chars if c.encode()[0] == first and probe.encode_ordinary(start.decode() + c)[0] == 256]
    return "".join(out)


def jvm_words(spark: SparkSession, text: Column, pattern: str) -> Column:
    """All matches of ``pattern``: white space by Unicode; letters and numbers that the library knows and Java's older tables do not count too.

    Texts with such a character take a pattern whose classes name them all, which is slower; the test for one looks only
    at characters from the first of them on.
    """
    every, wide = "", pattern
    least = 0x110000
    for name, members in _classes().items():
        (newer,) = spark.range(1).select(F.regexp_replace(F.lit(members), rf"\p{{{name}}}", "")).first()
        spans: list[list[int]] = []
        for code in map(ord, known_to_library(newer, name, pattern)):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
        extra = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)
        if extra:
            wide, every, least = _with_class(wide, rf"\p{{{name}}}", extra), every + extra, min(least, spans[0][0])
    found = lambda p: F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0))
    if not every:
        return found(pattern)
    high = F.regexp_like(text, F.lit(rf"[^\x00-\x{{{least - 1:X}}}]"))
    return F.when(high & F.regexp_like(text, F.lit(rf"(?=[^\x00-\x{{{least - 1:X}}}])[{every}]")), found(wide)).otherwise(found(pattern))


def _with_class(pattern: str, name: str, extra: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith(name, i):
            out.append(name + extra if inside else f"[{name}{extra}]")
            i += len(name)
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = (inside or pattern[i] == "[") and pattern[i] != "]"
        out.append(pattern[i : i + step])
        i += step
    return "".join(out)


def common_words(df: DataFrame, text: str, split: Column, path: str, most: int, rows: int = 24_000) -> DataFrame:
    """Words, ids and counts (w, ids, count): up to ``most`` words that a sample of about ``rows`` rows has most; they save time and change no result."""
    n = df.count()
    some = df.select(text).sample(min(1.0, rows / max(n, 1)), seed=1) if n > rows else df.select(text)
    found = some.select(F.explode(split).alias("w")).where(F.octet_length("w") <= LONGEST)
    best = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).repartition(32)
    held = best.select("w", "count", _rank_value(df.sparkSession, path).alias("__ranks"))
    return held.select("w", let(F.col("__ranks"), lambda table: fold(F.col("w"), table, path)).alias("ids"), "count")


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", memo: int = 1_000_000) -> DataFrame:
    """``df`` with the token ids of ``text`` as an array; empty for null and empty texts.

    Ids are those of the ranks in the file at ``path`` for each match of ``pattern`` by itself; special tokens are
    ordinary text. A column named ``into`` is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = jvm_words(df.sparkSession, body, pattern)
    whole = word_map(df.sparkSession, path, common_words(df, text, split, path, memo) if memo else None)
    # more than LONGEST bytes are at least LONGEST / 4 characters, all white space or none, besides a space before them
    maybe = F.regexp_like(body, F.lit(rf"(?<!\S)\S{{{LONGEST // 4}}}|(?<![{_SPACES}])[{_SPACES}]{{{LONGEST // 4}}}"))
    long = F.when(maybe, F.array_sort(F.array_distinct(F.filter(split, lambda w: F.octet_length(w) > LONGEST))))
    kept = [c for c in df.columns if c == text or c not in (into, "__long", "__long_ids", "__whole", "__ranks")]
    wide = df.select(*kept, long.alias("__long")).withColumn("__long_ids", _long_words(path)(F.col("__long")))
    long_one = lambda x: F.element_at("__long_ids", F.array_position("__long", x).cast("int"))

    def ids(w: Column, whole: Column, table: Column) -> Column:
        def looked_up(found: Column) -> Column:
            rare = F.array_sort(F.array_distinct(F.filter(w, lambda x, i: F.get(found, i) == '')))
            return let(rare, lambda r: let(folded(r), lambda made: put_back(found, r, made)))

        def folded(rare: Column) -> Column:
            short = F.transform(rare, lambda x: F.when(F.octet_length(x) > LONGEST, "").otherwise(x))
            return let(begun(short, path), lambda some: F.transform(rare, lambda x, i: F.when(F.octet_length(x) > LONGEST, long_one(x)).otherwise(merge_rest(F.get(some, i), table))))

        def put_back(found: Column, rare: Column, made: Column) -> Column:
            def place(x: Column, steps: Column) -> Column:
                return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(rare)) & (F.get(rare, at + s - 1) <= x), at + s).otherwise(at))

            steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s <= F.size(rare))
            return let(steps, lambda st: F.array_join(F.transform(found, lambda f, i: F.when(f == "", F.element_at(made, place(F.get(w, i), st))).otherwise(f)), ""))

        # in a text with one of the marks a word might be found across entries, so all its words are folded
        found = F.when(F.contains(body, F.lit(_BEGIN)) | F.contains(body, F.lit(_END)), F.transform(w, lambda x: F.lit(""))).otherwise(F.transform(w, lambda x: _find(whole, x)))
        joined = let(found, looked_up)
        return F.when(joined == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(joined, ""), lambda x: F.ascii(x) - _FIRST))

    # a function on arrays takes no subquery as it stands, so the maps are columns, which the optimizer puts in their only place of use
    held = wide.select(*kept, whole.alias("__whole"), _rank_value(df.sparkSession, path).alias("__ranks"), "__long", "__long_ids")
    return held.select(*kept, let(F.col("__whole"), lambda a: let(F.col("__ranks"), lambda b: let(split, lambda w: ids(w, a, b)))).alias(into))


def decode(ids: Column, path: str) -> Column:
    """The bytes of token ids, one piece after another; an id that the file lacks makes the result null."""
    held = ranks(path)
    pieces = [""] * (max(held.values()) + 1)
    for token, rank in held.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    joined = F.transform(ids, lambda i: F.get(table, i))
    return let(joined, lambda parts: F.unhex(F.when(~F.array_contains(parts, F.lit("")), F.array_join(parts, ""))))


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, hash of their decimal ids joined by commas, hash of the bytes decoded from them."""
    encoded = encode(docs.select("doc_id", "text"), path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256")
    )
