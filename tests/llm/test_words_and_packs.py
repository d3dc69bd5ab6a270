import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import matroska, mixing, packing, quality
from millrace.llm.tokens import WordEncoder
from tests.llm.fixtures import empty, hard, hard_rows, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def brute_quality(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_base_matches_brute_force(spark):
    got = [tuple(r) for r in quality.score_documents(hard(spark)).collect()]
    assert len(got) == len(hard_rows())
    want = Counter((r[0], *brute_quality(r[1])) for r in hard_rows())
    assert Counter(g[:6] for g in got) == want
    for g in got:
        assert g[6] == (g[1] < 10 or 100 * g[5] > 20 * g[1])
        assert not (g[6] and g[7])
    assert quality.score_documents(empty(spark)).count() == 0


def test_quality_stage_keeps_columns_and_agrees_with_the_verdict(spark):
    docs = hard(spark)
    kept = quality.keep_documents(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    verdicts = Counter(r.doc_id for r in quality.score_documents(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == verdicts


def test_cascade_counts_what_the_rules_before_leave(spark):
    """The wider rule comes first; the one within it then rejects nothing, so a narrow rule of its own comes before it."""
    rule = lambda name, low, high: quality.Rule(name, lambda d: sum(range(2000)) > 0 and low <= int(d.words[0]) < high)
    wide, within, apart, small = rule("wide", 0, 90), rule("within", 0, 30), rule("apart", 90, 96), quality.Rule("small", lambda d: int(d.words[0]) >= 90)
    docs = spark.createDataFrame([(str(i),) for i in range(100)], "text string")
    assert [r.name for r in quality.cascade_order(docs, (within, apart, wide))] == ["wide", "apart", "within"]
    assert [r.name for r in quality.cascade_order(docs, (apart, within), base=(small,))] == ["within", "apart"]
    assert {(r.rule, r.tried, r.rejected) for r in quality.measure(docs, (apart, within), base=(small,)).collect()} == {("apart", 90, 0), ("within", 90, 30)}
    assert quality.cascade_order(docs, ()) == () and quality.cascade_order(docs.where("false"), (apart, wide)) == (apart, wide)


def test_cascade_orders_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "word " * (30 if i % 2 else 3)) for i in range(40)], "doc_id long, text string")
    slow = quality.Rule("slow_useless", lambda d: sum(range(20_000)) < 0)
    ordered = quality.cascade_order(docs, (slow, *quality.RULES[:1]))
    assert [r.name for r in ordered] == ["few_words", "slow_useless"]


def test_the_sample_draws_rows_and_not_texts(spark):
    docs = spark.createDataFrame([(i, "same text " * 12 if i % 10 else f"w{i} " * 12) for i in range(6000)], "doc_id long, text string").repartition(4)
    for seed in range(4):
        tried = {r.tried for r in quality.measure(docs, sample_rows=200, seed=seed).collect()}
        assert len(tried) == 1 and 130 <= tried.pop() <= 280


def test_clusters_of_unknown_size_end_at_their_siblings():
    block = matroska._block(1, 0, [b"x" * 9], 0)
    cluster = bytes.fromhex("1f43b675") + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 3) + matroska.element(matroska.SIMPLE_BLOCK, block)
    for ident in (matroska.TAGS, matroska.CHAPTERS, matroska.ATTACHMENTS, matroska.SEEK_HEAD, matroska.CUES):
        data = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, cluster + matroska.element(ident, b"") + cluster)
        found = matroska.parse(data)
        assert found.error is None and len(found.packets) == 2 == len(found.clusters)


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_repeat_words_property(tokens):
    text = " ".join(tokens)
    assert quality.Document(text).n_repeat_words == brute_quality(text)[4]


def test_sainte_lague_matches_the_highest_quotients():
    rng = random.Random(3)
    for _ in range(200):
        votes = [rng.choice([0, 1, 2, 5, rng.randint(0, 500)]) for _ in range(rng.randint(1, 8))]
        seats, caps = rng.randint(0, 60), [rng.randint(0, 30) for _ in votes]
        given_ = [0] * len(votes)
        for _ in range(seats):
            open_ = [i for i in range(len(votes)) if votes[i] > 0 and given_[i] < caps[i]]
            if not open_:
                break
            best = max(open_, key=lambda i: (votes[i] / (2 * given_[i] + 1), -i))
            given_[best] += 1
        got = mixing.sainte_lague(np.array(votes), seats, np.array(caps)).tolist()
        assert sum(got) == sum(given_)
        assert sorted(v / (2 * g + 1) for v, g in zip(votes, got)) == pytest.approx(sorted(v / (2 * g + 1) for v, g in zip(votes, given_)))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mix_targets_and_takes(spark):
    rows = [r.asDict() for r in mixing.mix(hard(spark)).collect()]
    assert len(rows) == len(hard_rows())
    sizes = defaultdict(int)
    for r in hard_rows():
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(dict(sizes))
    source = {(r[0], len(words(r[1]))): r[3] for r in hard_rows()}
    taken = defaultdict(int)
    for r in rows:
        s = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 33
    again = [r.asDict() for r in mixing.mix(hard(spark).repartition(3)).collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    docs = hard(spark)
    plan = Counter((r.doc_id, r.taken) for r in mixing.mix(docs).where("taken > 0").collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, len(words(r.text))) for r in out.collect()) == plan


def test_mixed_documents_of_repeated_rows_keep_each_source_share(spark):
    """Equal texts under one id in three sources, many copies: words a source equal the plan, twice in a row."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(3)]
    rows = [(1, texts[0], s) for s in ("a", "b", None) for _ in range(40)] + [(None, texts[1], s) for s in ("a", "b", "b", "b")] + [(i, texts[2], "a") for i in range(30)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, copy int").repartition(3)
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(rows)
    planned = Counter()
    for r in plan:
        planned[r.source] += r.taken
    runs = [sorted((r.copy, r.source, r.text) for r in mixing.mixed_documents(docs.repartition(n)).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]
    got = Counter()
    for _, s, t in runs[0]:
        got[s] += len(words(t))
    assert got == planned
    targets = brute_targets({s: sum(60 for r in rows if r[2] == s) for s in ("a", "b", None)})
    assert all(abs(got[s] - targets[s]) <= 33 for s in targets)


def test_word_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(TOKENIZER)
    texts = [r[1] for r in hard_rows()] + ["don't STOP—now... I'll ﬁ ΣΑΣ İstanbul é ́x <|endoftext|>a 'sx x's 12ab_c", "x" * 5000]
    for small in (5, 400_000):
        got = WordEncoder(TOKENIZER, most=small).ids(texts)
        for t, ids in zip(texts, got):
            want = whole.encode(t or "", add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want


def test_the_memo_is_bounded_and_keeps_words_in_use():
    encoder = WordEncoder(TOKENIZER, most=20)
    calls, make = Counter(), encoder.words.make
    encoder.words.make = lambda key: calls.update([key]) or make(key)
    for i in range(60):
        encoder.ids([f"often word{chr(97 + i % 26)}{chr(97 + i // 26)} " + "y" * 100])
        assert len(encoder.words) <= 10 and len(encoder.words.old) <= 10
    assert calls[b"often"] == 1 and calls[b"y" * 100] == 60


def test_pack_documents_round_trip(spark):
    whole = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(hard(spark), TOKENIZER, with_ids=True).collect()
    want = Counter((r[0], tuple(whole.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in hard_rows() if r[0] not in (6,))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
    for doc, pieces in by_doc.items():
        if doc == 6:
            assert sum(p.length for p in pieces) == 2 * pieces[0].doc_tokens
            continue
        ids, at = [], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at, ids = at + p.length, ids + p.ids
        assert at == pieces[0].doc_tokens and want[(doc, tuple(ids))] == 1
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


@given(st.lists(st.one_of(st.integers(1, 200), st.integers(1, 9000), st.just(4096)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packs_cover_every_id_once_without_padding(lengths):
    pieces = packing.pack(lengths)
    assert sum(p[2] for p in pieces) == sum(lengths) and packing.padding(pieces) == 0
    assert all(p[2] > 0 and 0 <= p[1] and p[1] + p[2] <= lengths[p[0]] for p in pieces)


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8) * 5
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def brute_media(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_matroska_round_trip(spark):
    docs = hard(spark)
    rows = matroska.store_documents(docs, with_media=True)
    got = rows.collect()
    assert Counter((r[0], *r[1:5]) for r in got) == Counter((r[0], *brute_media(r[1])) for r in hard_rows())
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() for r in got)
    one = rows.where("doc_id = 4")
    media = bytes(one.collect()[0].media)
    table = matroska.packets(one, "doc_id").orderBy("frame").collect()
    assert b"".join(media[p.offset : p.offset + p.length] for p in table).startswith(hard_rows()[5][1].encode())
    assert {p.lacing for p in table} == set(matroska.LACINGS) and {p.codec for p in table} == {"A_PCM/INT/LIT"}
    assert [p.timestamp_ns for p in table] == sorted(p.timestamp_ns for p in table) and sum(p.cued for p in table) > 0
    assert matroska.store_documents(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(media[:2000]))], "doc_id long, media binary")
    assert {r.doc_id for r in matroska.packets(nothing, "doc_id").collect()} <= {3}


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_laces_of_uneven_frames(lacing):
    frames = [b"a" * n for n in ((300, 255, 1, 700) if lacing != 2 else (50, 50, 50))]
    block = matroska._block(1, 5, frames, lacing)
    segment = matroska.element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, block))
    data = matroska.element(matroska.EBML, b"") + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + segment
    found = matroska.parse(data)
    assert found.error is None and [p[6] for p in found.packets] == [len(f) for f in frames]
    assert {p[1] for p in found.packets} == {12_000_000}


def test_every_frame_count_reads_back_as_it_was_stored():
    for n in range(1, 131):
        payload = b"".join(struct.pack("<I", k) for k in range(144 * n))
        media = matroska.mux(payload)
        found = matroska.parse(media)
        assert found.error is None and {p[6] for p in found.packets} == {matroska.FRAME}
        assert [p[1] for p in found.packets] == [576 * i * 10**9 // 48000 for i in range(n)] and found.durations == {1: 12_000_000}
        assert b"".join(media[p[5] : p[5] + p[6]] for p in found.packets) == payload


def test_matroska_of_other_writers():
    """Fields of an entry in any order, several positions of a cue point, and nesting without end."""
    m = matroska
    entries = b"".join(m.element(m.TRACK_ENTRY, m.element(m.CODEC_ID, c) + m._uint(m.DEFAULT_DURATION, d) + m._uint(m.TRACK_NUMBER, n)) for n, c, d in ((1, b"V_VP9", 40), (2, b"A_OPUS", 20)))
    cluster = m.element(m.CLUSTER, m._uint(m.TIMESTAMP, 3) + m.element(m.SIMPLE_BLOCK, m._block(1, 0, [b"xx", b"yy"], 2)) + m.element(m.SIMPLE_BLOCK, m._block(2, 0, [b"z"], 0)))
    tracks = m.element(m.TRACKS, entries)
    position = lambda track: m.element(m.CUE_POSITIONS, m._uint(m.CUE_TRACK, track) + m._uint(m.CUE_CLUSTER, len(tracks)))
    cues = m.element(m.CUES, m.element(m.CUE_POINT, position(1) + position(2) + m._uint(m.CUE_TIME, 3)))
    found = m.parse(m.element(m.EBML, b"") + m.element(m.SEGMENT, tracks + cluster + cues))
    assert found.error is None and found.codecs == {1: "V_VP9", 2: "A_OPUS"} and found.durations == {1: 40, 2: 20}
    assert found.cues == [(3, 1, len(tracks)), (3, 2, len(tracks))]
    assert [(p[0], p[1], p[-1]) for p in found.packets] == [(1, 3_000_000, True), (1, 3_000_040, False), (2, 3_000_000, True)]
    deep = (m.SEGMENT.to_bytes(4, "big") + b"\xff") * 3_000
    assert m.parse(deep).error == "elements nest too deep" and m.parse(deep).packets == []
