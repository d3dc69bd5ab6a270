"""Byte-level BPE against the library, resampling and fill-in-middle against plain code, on hard rows and the whole small table."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, fill_middle, registry, resampling, token_counts
from tests.llm.fixtures import empty, hard, hard_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    "", None, " ", "a", "don't  we'll\n\n\tx ", "naïve Ünïcode ß", "日本語のテキストは空白を使わないので長い語になることがあります。" * 3, "a" * 3000, "ab" * 700 + "!", "#" * 500, "x" * 65, "x" * 64,
    "\x00\x01 \x02b\x01", "    x", "\U0001f600 emoji\U0001f600\U0001f600", "ᲊ Ᲊ ࡰ \U0001e030", "12345 ６７", "!\u001c!", "<|endoftext|>", "tab\tend\r\n", "word " * 400,
    "".join(random.Random(3).choice("abcdefghij") for _ in range(700)), "q́z" * 40,
]


def test_ids_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for memo in (0, 50):
        got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, memo=memo).collect()}
        for i, text in enumerate(TEXTS):
            assert got[i] == LIBRARY.encode_ordinary(text or ""), repr(text)[:60]


def test_texts_with_the_marks_of_the_literal_maps(spark):
    """Characters that part entries and buckets, and those that stand for ids there, are words like others."""
    texts = ["\ufffe the\uffff", "the\uffff\U00010000\ufffethe", "\ufdd0 a\ufdd0", "\U00010000\U00010001=\U00010002;", "=; ,= ;;", "\U0010ffff", "x\U0001c34f\U0001c350y"]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, memo=50).collect()}
    assert [got[i] for i in range(len(texts))] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_a_bucket_of_pairs_is_one_string(spark):
    df = spark.range(1).select(byte_bpe.rank_map(PATH).alias("t"))
    assert df.schema["t"].dataType.simpleString() == "array<string>"
    words = spark.createDataFrame([(w,) for w in ("", "a", "é", "tionableness", "\x00\x7f", "日本語")], "w string")
    for r in words.select("w", byte_bpe.let(byte_bpe.rank_map(PATH), lambda t: byte_bpe.fold(F.col("w"), t, PATH)).alias("ids")).collect():
        assert [ord(c) - byte_bpe._FIRST for c in r.ids] == byte_bpe.merge_heap(r.w.encode(), RANKS), r.w


def test_merges_made_in_all_words_at_once(spark, tmp_path):
    """Ids equal one-by-one merging, also by a table in which a later merge brings back a lower rank or pairs of one rank overlap."""
    r = random.Random(6)
    made = [b"the", b"he", b"th", b"aa", b"aaa", b"in", b"ing"], [b"he", b"th", b"the", b"in", b"aa", b"aaa", b"ing"], [b"aa", b"aaa", b"th", b"the"], []
    for k, tokens in enumerate(made):
        path = tmp_path / f"{k}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*(bytes([b]) for b in range(256)), *tokens])))
        table = byte_bpe.ranks(str(path))
        words = spark.createDataFrame([("".join(r.choices(["t", "h", "e", "a", "in", "g", "é", "\x00"], k=r.randrange(1, 14))),) for _ in range(150)] + [("",)], "w string")
        got = words.select("w", byte_bpe.let(byte_bpe.rank_map(str(path)), lambda t: byte_bpe.fold(F.col("w"), t, str(path))).alias("ids")).collect()  # noqa: B023
        for row in got:
            assert [ord(c) - byte_bpe._FIRST for c in row.ids] == byte_bpe.merge_heap(row.w.encode(), table), (k, row.w)
    assert [len(byte_bpe.first_merges(str(tmp_path / f"{k}.tiktoken"))) for k in range(4)] == [1, 5, 1, 0]
    assert len(byte_bpe.first_merges(PATH)) > 50


def test_words_known_beforehand_are_no_literal_of_the_plan(spark):
    """The map of words is made by Spark and put once where it is used; it is neither text of the plan nor a column of its rows."""
    docs = spark.createDataFrame([(i, f"zqxword{chr(97 + i)}w zqxwordkept \u3000 \u3000 \u3000 \u3000 \u3000 \u3000 \u3000 \u3000 \u3000x") for i in range(4)] * 2, "doc_id long, text string")
    out = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert "zqxword" not in plan.toString() and "scalar-subquery" in plan.toString()
    below = plan.children().apply(0).output()
    assert not {"__whole", "__ranks"} & {below.apply(i).name() for i in range(below.size())}
    assert chr(byte_bpe._FIRST + 50_000) not in plan.toString()
    texts = {r.doc_id: r for r in out.collect()}
    assert len(texts) == 4 and all(r.ids == LIBRARY.encode_ordinary(r.text) for r in texts.values())


def test_long_runs_of_mixed_white_space(spark):
    """White space of ASCII and beyond by turns, above the length that the fold takes."""
    texts = [f"a{''.join(chr(c) + ' ' for c in [space] * 40)}b" for space in (0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, memo=0).collect()}
    assert [got[i] for i in range(len(texts))] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_decoding_joins_pieces(spark):
    df = spark.createDataFrame([([0, 1, 50255],), ([],), ([50256],), (None,)], "ids array<int>")
    by_rank = {r: t for t, r in RANKS.items()}
    assert [r[0] for r in df.select(byte_bpe.decode(F.col("ids"), PATH)).collect()] == [by_rank[0] + by_rank[1] + by_rank[50255], b"", None, None]


def test_long_words_by_heap_equal_the_library():
    for word in ("a" * 20_000, "".join(random.Random(5).choice("abcdefgh") for _ in range(5_000)), "日本語" * 400):
        assert byte_bpe.merge_heap(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


def test_every_character_is_split_as_the_library_does(spark):
    """Each character between letters, digits and signs: its class decides what stays together."""
    odd = [c for c in [*range(0xD800), *range(0xE000, 0x110000)] if regex.match(r"[\p{L}\p{N}\s\p{Cn}]", chr(c)) is None or c % 7 == 0 or c < 0x3000]
    rows = spark.createDataFrame([(i, "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! " for c in odd[i : i + 500])) for i in range(0, len(odd), 500)], "doc_id long, text string").repartition(8)
    split = byte_bpe.jvm_words(spark, F.col("text"), public_tokenizers.PATTERN)
    cuts = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for r in rows.select("text", split.alias("w")).collect():
        assert [i for w in r.w for i in cuts.encode_ordinary(w)] == cuts.encode_ordinary(r.text)


def test_whole_table_of_token_digests(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_hard_rows_and_empty_tables(spark):
    for fn in (lambda df: byte_bpe.token_digests(df, PATH, public_tokenizers.PATTERN), fill_middle.middle_digests, lambda df: resampling.resample(df, df)):
        assert fn(empty(spark)).count() == 0
        assert Counter(r.doc_id for r in fn(hard(spark)).collect()) == Counter(r[0] for r in hard_rows())


def brute_features(text, orders):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, orders, share=(10, 100), least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, brute_features(text, orders)[1]))
    big_s, big_t, out = sum(s.values()), sum(t.values()), []
    for i, text in rows:
        words, found = brute_features(text, orders)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: share[0] * len(fit) // share[1]], 1):
        r[5] = rank
    return sorted(((i, n, w, sc, k) for i, _, n, w, sc, k in out), key=repr)


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_equals_brute_force(spark, orders):
    rng = random.Random(orders)
    names = ["alpha", "Beta", "gamma", "é", "x9", "DELTA"]
    rows = [(i, " ".join(rng.choice(names) for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(300)] + [(None, "alpha " * 30), (7, None), (8, ""), (300, "beta-gamma " * 15)]
    target = ["alpha beta", "GAMMA é é", None, ""]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, aim, share=(30, 100), orders=orders)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, orders, (30, 100))


def test_ranks_do_not_depend_on_ranges(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 37 % 50).alias("score"))
    want = [tuple(r) for r in resampling.ranked(rows, 1000, "score", ["id"], per_task=10_000).select("id", "rank").orderBy("id").collect()]
    assert [tuple(r) for r in resampling.ranked(rows, 1000, "score", ["id"], per_task=30).select("id", "rank").orderBy("id").collect()] == want
    assert sorted(r for _, r in want) == list(range(1, 1001))


def brute_middle(key, text, unit, marks=("<P>", "<S>", "<M>"), rate=100):
    text = text or ""
    patterns = {"lines": r"[^\n]*\n|[^\n]+", "words": r"(?s).+?(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])|.+", "characters": r"(?s)."}
    units = re.findall(patterns[unit], text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
@pytest.mark.parametrize("size", [1, 3, 4096])
def test_middles_equal_brute_force(spark, unit, size):
    rng = random.Random(size)
    texts = ["", None, "\n", "\n\n\n", "no end", "a\nb\n", "with <P> mark", "é\n\U0001f600\n\n x\ty  z\n" * 4, "  lead", "x" * 5000 + "\n" + "y" * 5000]
    texts += ["".join(rng.choice("ab \n\U0001f600") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    rows = [(i, t, 5, "f") for i, t in enumerate(texts)] + [(None, "null key\nline", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string")
    if size == 1:
        docs = docs.where("length(text) < 2000 or text is null")
        rows = [r for r in rows if len(r[1] or "") < 2000]
    made = fill_middle.fill_in_middle(docs, unit=unit, size=size).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()}
    assert got == {i: (*brute_middle(i, t, unit), t or "") for i, t, *_ in rows}


def test_middles_of_a_very_long_text(spark):
    text = "line of words é\n" * 60_000
    row = fill_middle.middle_digests(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()[0]
    want = brute_middle(3, text, "lines")
    assert tuple(row)[1:5] == want[:4] and row.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest() and row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_white_space_of_every_length_is_linear():
    import time

    encoding, _ = token_counts.byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", " b", "é", "!", "1", " " * rng.randint(1, 40), "\n" * rng.randint(1, 30), "\u3000 \t" * rng.randint(1, 12)]) for _ in range(rng.randint(1, 12)))
        assert token_counts.encode(encoding, text) == encoding.encode_ordinary(text)
    for run in (20, 2_500, 9_999, 10_001, 1_000_000):
        began = time.perf_counter()
        token_counts.encode(encoding, (" " * run + "x") * (1_000_000 // run))
        assert time.perf_counter() - began < 5
