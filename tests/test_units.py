"""Boundary values, folds against direct simulation, streams against batches."""

import datetime as dt
import json
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import classify as K
from millrace.functions import text as X
from millrace.functions import timing as T
from millrace.functions.partial_json import Closer, complete
from millrace.operators import anchored as A
from millrace.operators import ingredients as G
from millrace.operators import lookup as L
from millrace.operators import runs as U
from millrace.operators import search as S
from millrace.operators import tables as B
from millrace.operators.history import from_row, merge_history, to_row
from millrace.operators.parted import PartedTable
from millrace.operators.sse import carried, fold_text, lines_of_chunks
from millrace.sources.streams import sse_lines, write_sse_lines


def values(spark, kind, cases, fn):
    """Results of a column function over (input, expected) pairs, in order."""
    rows = [(i, v) for i, (v, _) in enumerate(cases)]
    out = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in out]


CASES = [
    ("int", K.score_tier, [(None, "POOR"), (0, "POOR"), (29, "POOR"), (30, "BELOW AVERAGE"), (49, "BELOW AVERAGE"), (50, "AVERAGE"), (69, "AVERAGE"), (70, "GOOD"), (84, "GOOD"), (85, "EXCELLENT"), (100, "EXCELLENT")]),
    ("string", X.normalize_key, [(None, ""), ("", ""), ("Acme® Dog Food (TM)", "acme"), ("dog  food", "dog food"), ("dog-food", "dogfood"), ("éformula test", "test"), ("A B", "a b"), ("Formula Recipe", ""), ("(R)X", "x"), ("formulas", "formulas")]),
    ("string", X.shorten, [(None, ""), ("a" * 16, "a" * 16), ("a" * 17, "a" * 17), ("Adult Dogs (1+ years)", "Adult Dogs"), ("one two three four", "one two"), ("supercalifragil istic", "supercalifragil")]),
    ("string", X.truncate_pill, [(None, None), ("x" * 35, "x" * 35), ("x" * 36, "x" * 35), (" " + "x" * 40, " " + "x" * 34), ("short words " * 4, "short words short words short words"[:29])]),
    ("long", X.review_count, [(None, None), (0, None), (999, "999"), (1000, "1K"), (1450, "1.5K"), (1449, "1.4K"), (12000, "12K"), (9960, "10.0K")]),
    ("string", X.recall_clean, [(None, None), ("None", True), ("none reported", True), ("No recall", True), ("no recalls ever", True), ("Nonesuch", False), ("2 recalls", False)]),
    ("string", X.clean_placeholder, [(None, None), ("", None), ("N/A", None), ("Unknown", None), ("12%", "12%")]),
    ("string", X.strip_fence, [("```json\n{\"a\":1}\n```", '{"a":1}'), ("```\nx```", "x"), (" y ", "y")]),
    ("string", X.initials, [("ann lee kim", "AL"), ("bo", "B"), ("a  b", "AB")]),
    ("string", G.is_valid_analysis, [('{"productName":"x","overallScore":1}', True), ('{"productName":"x","overallScore":100}', True), ('{"productName":"x","overallScore":0}', False), ('{"productName":"x","overallScore":101}', False), ('{"productName":"x","overallScore":"50"}', False), ('{"productName":"","overallScore":5}', False), ('{"productName":"x","overallScore":5,"error":"e"}', False), (None, False), ("[1]", False)]),
    ("array<string>", lambda a: G.rating_shares(a)["total"], [([], None), (None, None), (["good", "odd"], 2)]),
]


@pytest.mark.parametrize("kind,fn,cases", CASES)
def test_boundary_values(spark, kind, fn, cases):
    assert values(spark, kind, cases, fn) == [want for _, want in cases]


def test_pet_type(spark):
    rows = [("Dog and cat", None, None, "dog"), ("delicate", "", [], "cat"), (None, "chien", None, "dog"), (None, None, ["x", "en:chat"], "cat"), ("bird", None, None, "unknown")]
    df = spark.createDataFrame(rows, "n string, c string, t array<string>, w string")
    assert df.where(X.detect_pet_type(F.col("n"), F.col("c"), F.col("t")) != F.col("w")).count() == 0


def test_relative_dates(spark):
    now = dt.datetime(2024, 1, 10, 12)
    ages = [(-5, "Just now"), (59, "Just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago"), (6 * 86400, "6d ago"), (7 * 86400, "2024-01-03")]
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s), w) for s, w in ages], "t timestamp, w string")
    assert df.where(T.relative_date(F.col("t"), F.lit(now)) != F.col("w")).count() == 0


def simulate(kind, events, gap, most=2):
    """The stored procedure and the throttles, event by event."""
    state, out = {}, {}
    for key, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        start, n = state.get(key, (None, 0))
        if kind == "admit":
            if start is None or start < t - gap:
                start, n, ok = t, 1, True
            elif n >= most:
                ok = False
            else:
                n, ok = n + 1, True
        else:
            ok = start is None or t - start >= gap
            start = t if ok else start
        state[key], out[i] = (start, n), ok
    return out


def random_events(seed):
    rng = random.Random(seed)
    return [(rng.randint(0, 4), i, rng.choice([0, 100, 200, rng.randint(0, 3000)]) * 1_000_000) for i in range(300)]


def frame(spark, events):
    return spark.createDataFrame(events, "k long, i long, us long").withColumn("ts", F.timestamp_micros("us")).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_anchored_windows_equal_the_simulation(spark, seed):
    events = random_events(seed)
    df = frame(spark, events)
    for most in (0, 1, 3):
        got = {r.id: r.allowed for r in A.admit(df, "k", "ts", "i", most=most, minutes=1).collect()}
        want = simulate("admit", events, 60_000_000, most)
        assert got == want
    got = {r.id: r.accepted for r in A.suppress_repeats(df, "k", "ts", "i", 60_000_000).collect()}
    assert got == simulate("suppress", events, 60_000_000)


@pytest.mark.parametrize("gap", [0, 1, 7, 50, 5_000])
@pytest.mark.parametrize("strict", [True, False])
def test_hot_keys_split_over_blocks(spark, gap, strict):
    """Keys cut into many blocks on several levels give what one fold gives, rank for rank."""
    rng = random.Random(gap)
    rows = [(1, i, rng.randint(0, 3000)) for i in range(1500)] + [(2, i, (i // 40) * 400 + rng.randint(0, 9)) for i in range(2000, 2700)] + [(3, 9000, 5)] + [(4, i, 77) for i in range(9100, 9200)]
    df = spark.createDataFrame(rows, "k long, i long, us long").withColumn("ts", F.timestamp_micros("us")).repartition(3)
    got = {r.id: (r.window_start, r.rank) for r in A.anchored_windows(df, "k", "ts", "i", gap, strict, block=20, group=3).collect()}
    want, state = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(k, (None, 0))
        inside = start is not None and (t <= start + gap if strict else t < start + gap)
        state[k] = (start, n + 1) if inside else (t, 1)
        want[i] = state[k]
    assert got == want


def test_one_key_of_many_events_is_many_tasks(spark):
    df = spark.range(400_000).select(F.lit(1).alias("k"), "id", F.timestamp_micros(F.col("id") * 7 % 400_009 * 1000).alias("ts"))
    split = A.anchored_windows(df, "k", "ts", "id", 60_000, True, block=20_000, group=4)
    whole = A.anchored_windows(df, "k", "ts", "id", 60_000, True)
    assert split.exceptAll(whole).isEmpty() and split.count() == 400_000
    assert split.groupBy(F.spark_partition_id()).count().count() > 1


def test_trailing_throttle_equals_the_timers(spark):
    events, gap = random_events(3), 60_000_000
    want = []
    for key in {e[0] for e in events}:
        last, pending = None, None
        for _, i, t in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            if pending is not None and last + gap <= t:
                last, pending = last + gap, want.append((key, pending, last + gap, True))
            if last is None or t - last >= gap:
                want.append((key, i, t, False))
                last = t
            else:
                pending = i
        if pending is not None:
            want.append((key, pending, last + gap, True))
    got = [tuple(r) for r in A.throttle_trailing(frame(spark, events), "k", "ts", "i", gap).collect()]
    assert sorted(got) == sorted(want)


def test_exact_edges_of_admission_and_expiry(spark):
    df = frame(spark, [(1, 1, 0), (1, 2, 60_000_000), (1, 3, 60_000_001)])
    assert [r.rank for r in A.admit(df, "k", "ts", "i", most=1, minutes=1).orderBy("id").collect()] == [1, 2, 1]
    now = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("a", "x", None, None, now), ("b", "y", "verified", None, now + dt.timedelta(microseconds=1)), ("", "z", None, None, dt.datetime(2030, 1, 1))], "cache_key string, analysis string, data_source string, opff_data string, expires_at timestamp")
    keys = spark.createDataFrame([("a",), ("b",), ("",)], "cache_key string")
    assert {r.cache_key: r.hit for r in L.cache_lookup(cache, keys, F.lit(now)).collect()} == {"a": False, "b": True, "": False}
    assert {r.cache_key for r in B.delete_expired(cache, F.lit(now)).collect()} == {"a", "b", ""}


def test_point_lookup_wants_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert L.one_row(df, "k", F.lit(1)).collect()[0].v == "a"
    with pytest.raises(Exception, match="exactly one row"):
        L.one_row(df, "k", F.lit(2)).collect()


def test_history_merge(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    remote = spark.createDataFrame([(i, day(i)) for i in range(60)], "id int, date_scanned timestamp")
    local = spark.createDataFrame([(5, day(5)), (100, day(59)), (101, day(70))], "id int, date_scanned timestamp")
    got = [r.id for r in merge_history(remote, local).orderBy(F.desc("date_scanned"), "src", "id").collect()]
    assert got[:3] == [101, 100, 59] and len(got) == 50
    assert merge_history(remote.where("false"), local).count() == 3
    row = spark.createDataFrame([(1, "safe")], "id int, safety_level string")
    assert from_row(row).columns == ["id", "safetyLevel"] and to_row(from_row(row)).collect() == row.collect()


def test_upsert_and_migration(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 7)], "k int, v string, hits int")
    changes = spark.createDataFrame([(1, "x", 0, 1), (1, "y", 0, 2), (3, "z", 0, 1), (None, "m", 0, 1)], "k int, v string, hits int, seq int")
    got = {r.k: (r.v, r.hits) for r in B.upsert(base, changes, ["k"], "seq", kept=("hits",)).collect()}
    assert got == {1: ("y", 5), 2: ("b", 6), 3: ("z", 0), None: ("m", 7)}


def test_no_marker_before_success(spark, tmp_path):
    """A failure between the two writes leaves no marker; the next run does all again, the one after it nothing."""
    root = f"file://{tmp_path}/m"
    target, current = spark.createDataFrame([(1, "a", 0)], "id int, owner string, score int"), spark.createDataFrame([(5, "b", 50, 1), (6, "c", 60, 1)], "id int, owner string, score int, v int")
    legacy = spark.createDataFrame([(1, "a", 11, 1), (2, "a", 12, 1)], current.schema)
    owners, present = spark.createDataFrame([("a",), ("b",), ("c",)], "owner string"), spark.createDataFrame([("a",), ("c",)], "owner string")
    run = lambda legacy, **kw: B.migrate(root, target, legacy, current, owners, "owner", ["id", "owner"], "v", present, **kw)

    def away(df, path):
        raise OSError("no marker")

    with pytest.raises(OSError, match="no marker"):
        run(legacy, write_marker=away)
    assert B.migrated_table(spark, root) == (None, None, 0)
    want = {(1, "a", 11), (2, "a", 12), (5, "b", 50)}  # c has a list that is empty
    assert {tuple(r) for r in run(legacy).collect()} == want
    assert {r.owner for r in B.migrated_table(spark, root)[1].collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in run(legacy.withColumn("score", F.lit(99))).collect()} == want


def test_swapped_versions(spark, tmp_path):
    B.swap(spark.range(3), f"file://{tmp_path}/t", "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        B.swap(spark.range(3), f"file://{tmp_path}/t", "1")
    assert spark.read.parquet(B.swap(spark.read.parquet(f"file://{tmp_path}/t/version=1").where("id > 0"), f"file://{tmp_path}/t", "2")).count() == 2


def test_only_touched_parts_are_written(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string, hits int, expires_at timestamp").schema
    t = PartedTable(spark, f"file://{tmp_path}/t", schema, ("k",), buckets=8, expires="expires_at")
    at = lambda day: F.timestamp_seconds(F.lit(day * 86400 + 3600))
    rows = lambda df: {r.k: (r.v, r.hits) for r in df.collect()}
    first = spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("hits"), at(10).alias("expires_at"), F.lit(0).alias("seq"))
    assert t.rows().collect() == [] and t.heads() == (0, [])
    assert t.upsert(first, "seq") == 8
    assert t.upsert(first.where("false"), "seq") == 0 and t.heads()[0] == 1  # nothing changes, nothing is written
    # one key moves to a later day, so its old part and its new one are written and the others stay
    moved = first.where("k = 7").select("k", F.lit("b").alias("v"), F.lit(0).alias("hits"), at(12).alias("expires_at"), "seq")
    nothing = spark.createDataFrame([(None, "n", 5, None, 1), (None, "m", 4, None, 0)], "k int, v string, hits int, expires_at timestamp, seq int")
    assert t.upsert(moved.unionByName(nothing), "seq", kept=("hits",)) == 3
    version, heads = t.heads()
    assert version == 2 and sorted(h.made for h in heads) == [1] * 7 + [2] * 3
    want = {k: ("a", 1) for k in range(200)} | {7: ("b", 1), None: ("n", 5)}
    assert rows(t.rows()) == want
    updates = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (999, "z", 1)], "k int, v string, seq int")
    assert t.update(updates, "v", "seq") == 1 and rows(t.rows()) == want | {7: ("y", 1)}
    # strictly before: what expires just now stays; whole days go without being read
    assert t.delete_expired(at(10)) == 8 and len(rows(t.rows())) == 201
    assert t.delete_expired(at(11)) == 8 and rows(t.rows()) == {7: ("y", 1), None: ("n", 5)}
    assert t.delete_expired(at(13)) == 1 and rows(t.rows()) == {None: ("n", 5)}
    with pytest.raises(ValueError):
        t.update(updates, "k", "seq")


def test_parts_without_heads_do_not_count(spark, tmp_path, monkeypatch):
    """A change that fails between data and heads leaves the table as it was; it is run again over the same version."""
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    t = PartedTable(spark, f"file://{tmp_path}/t", df.drop("seq").schema, ("k",), buckets=4)
    t.upsert(df, "seq")
    change = df.withColumn("v", F.lit("c"))
    parts = PartedTable._parts

    def away(dealt):
        if dealt.columns == ["__bucket", "__day"]:  # the data just written
            raise OSError("no heads")
        return parts(dealt)

    with monkeypatch.context() as m:
        m.setattr(PartedTable, "_parts", staticmethod(away))
        with pytest.raises(OSError, match="no heads"):
            t.upsert(change, "seq")
    assert t.heads()[0] == 1 and {r.v for r in t.rows().collect()} == {"a", "b"}
    t.upsert(change, "seq")
    assert t.heads()[0] == 2 and {r.v for r in t.rows().collect()} == {"c"}


def test_postings_read_their_buckets_only(spark, tmp_path):
    rows = [(i, f"common w{i % 7}") for i in range(50)] * 2 + [(None, "common"), (99, None), (3, "")]
    path = f"file://{tmp_path}/p"
    S.write_postings(spark.createDataFrame(rows, "code long, name string"), path, "code", "name")
    asked = spark.createDataFrame([("common",), ("common",), ("w3",), ("none",), (None,)], "term string")
    got = sorted(tuple(r) for r in S.search(asked, path).collect())
    assert got == [("common", i + 1, i) for i in range(5)] + [("w3", i + 1, 3 + 7 * i) for i in range(5)]
    plan = S.postings(spark, path, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_file_of_lines_is_many_tasks(spark, tmp_path):
    want = [f"{i} zażółć " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "s.txt").write_text("\n".join(want))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = sse_lines(spark, f"file://{tmp_path}/s.txt")
        assert read.rdd.getNumPartitions() > 8
        assert [r.line for r in sorted(read.collect(), key=lambda r: r.seq)] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_event_lines(spark, tmp_path):
    line = lambda t: "data: " + json.dumps({"type": "content_block_delta", "delta": {"text": t}})
    rows = [(1, 0, line("He")), (1, 1, "data: {oops"), (1, 2, line("llo")), (1, 3, "data: [DONE]"), (1, 4, line("!")), (2, 0, ": ping"), (2, 1, line("")), (3, 0, line("x"))]
    df = spark.createDataFrame(rows, "stream_id long, seq long, line string")
    assert {r.stream_id: r.text for r in fold_text(df).collect()} == {1: "Hello", 2: "", 3: "x"}
    whole = "\n".join(r[2] for r in rows[:4])
    chunks = spark.createDataFrame([(1, i, whole[i * 7 : i * 7 + 7]) for i in range(len(whole) // 7 + 1)], "stream_id long, seq long, chunk string")
    assert fold_text(lines_of_chunks(chunks)).collect()[0].text == "Hello"
    assert fold_text(lines_of_chunks(chunks, carry=False)).collect()[0].text == ""
    (tmp_path / "s.txt").write_text(whole)
    read = sse_lines(spark, f"file://{tmp_path}/s.txt")
    assert fold_text(read.withColumnRenamed("stream_file", "stream_id")).collect()[0].text == "Hello"


DOCS = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@given(st.dictionaries(st.text(max_size=4), DOCS, max_size=4), st.integers(1, 200))
@settings(max_examples=200, deadline=None)
def test_partial_json_always_parses(doc, cut):
    text = json.dumps(doc)
    closed = complete(text[:cut])
    assert closed is not None and isinstance(json.loads(closed), dict)
    if cut >= len(text):
        assert json.loads(closed) == doc


def closable(text):
    """The longest prefix that some closing makes a document of, by trial; unfinished strings that are keys do not count."""
    for end in range(len(text), 0, -1):
        stack, in_string, escaped = [], False, False
        for ch in text[:end]:
            if in_string:
                escaped, in_string = ch == "\\" and not escaped, ch != '"' or escaped
            elif ch == '"':
                in_string = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]" and stack:
                stack.pop()
        if not in_string and not any(c in ' \t\n\r,:{}[]"' for c in text[end - 1 : end + 1]) and end < len(text):
            continue  # within a number or a literal: its beginning is not the value
        made = text[:end] + ('"' if in_string else "") + "".join(reversed(stack))
        try:
            json.loads(made, parse_constant=lambda _: 1 / 0)
            return made
        except (ValueError, ZeroDivisionError):
            continue
    return None


@given(DOCS, st.integers(1, 120), st.integers(1, 9), st.sampled_from(["", "x", "]", " ,", '"', "\\", "\t"]))
@settings(max_examples=300, deadline=None)
def test_partial_json_by_chunks_equals_the_longest_closable_prefix(doc, cut, size, junk):
    text = json.dumps(doc, indent=None if cut % 2 else 1)[:cut] + junk
    closer, fed = Closer(), ""
    for i in range(0, len(text), size):
        fed += text[i : i + size]
        assert closer.feed(text[i : i + size]).closed() == closable(fed)


def test_partial_json_of_ten_million_characters():
    text = json.dumps({"a": [{"k": "v" * 50, "n": i, "e": "\n\u00e9"} for i in range(110_000)]})
    closer, began = Closer(), time.perf_counter()
    for i in range(0, len(text) - 5, 1_000):
        closer.feed(text[i : i + 1_000])
    assert json.loads(closer.closed()) == json.loads(text) and len(text) > 9_000_000 and time.perf_counter() - began < 60
    assert json.loads(complete("[" * 50_000 + "1")[:10] + "]" * 10) is not None


def test_lines_hold_no_more_than_the_open_one(spark):
    """A stream of 64 MB in chunks: every batch of lines stays small."""
    rows = pa.RecordBatch.from_arrays([pa.array([1] * 1000), pa.array(range(1000)), pa.array(["x" * 6_000 + "\n" + "y" * 58_000] * 1000)], names=["k", "s", "t"])
    sizes = [(b.num_rows, b.nbytes) for b in carried([rows])]
    assert sum(n for n, _ in sizes) == 1001 and max(size for _, size in sizes) < 20_000_000


def test_partial_json_keeps_what_came():
    assert json.loads(complete('{"a": "he')) == {"a": "he"} and json.loads(complete('{"a": [1, {"b": tr')) == {"a": [1, {}]} and complete("") is None and complete(None) is None


def test_single_flight_and_slots(spark):
    runs = [(1, 0, "error"), (1, 1, "running"), (1, 2, "complete"), (2, 0, "complete"), (2, 1, "error")]
    df = spark.createDataFrame(runs, "k int, s int, status string")
    got = {(r.k, r.s): r.started for r in U.single_flight(df, "k", [F.col("s")], F.col("status")).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 0): True, (2, 1): False}
    aliases = spark.createDataFrame([(2, 1)], "alias int, target int")
    slot = U.slot_owner(df.withColumn("run", F.col("k") * 10 + F.col("s")), aliases, "k", "run", "s", "status").collect()
    assert [(r.canonical, r.owner) for r in slot] == [(1, 20)]


def test_name_keys_are_what_step_by_step_cleaning_gives(spark):
    names = ["", " ", "large ring", "Large  Ring", "dog food", "old dog food", "dogfood", "formula1", "my formula", "a\u00a0b", " a", "a ", "a\tb", "a\n", "Hill's (R) Cat Food 2", "dog (c)food", "®", "x ® y", "ring\u2028", "é", "recipes", "a  b", "İ x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    steps = F.lower("n")
    for pattern, by in ((r"\(r\)|\(tm\)|\(c\)|®|™|©", ""), (r"(?<![A-Za-z0-9_])(dog food|cat food|formula|recipe)(?![A-Za-z0-9_])", ""), (f"[^a-z0-9{X.WS}]", ""), (f"[{X.WS}]+", " "), (f"^[{X.WS}]+", ""), (f"[{X.WS}]+$", "")):
        steps = F.regexp_replace(steps, pattern, by)
    for row in df.select("n", X.normalize_key(F.col("n")).alias("got"), F.coalesce(steps, F.lit("")).alias("want")).collect():
        assert row.got == row.want, row


def test_name_keys_are_made_once_a_row_and_not_by_the_join(spark):
    scans = spark.createDataFrame([(1, None, "Old Ring", "nothing"), (2, 7, "x", "y"), (3, None, "", None), (4, None, "dog food", "old ring!")], "id long, bar long, full string, part string")
    catalog = spark.createDataFrame([(7, "Bolt"), (9, "old  ring"), (8, "OLD RING"), (6, "formula")], "barcode long, product_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = L.enrich(scans, catalog, "bar", "full", "part")
        assert sorted((r.id, r.product_code, r.data_source) for r in out.collect()) == [(1, 8, "enriched"), (2, 7, "enriched"), (3, None, "ai"), (4, 8, "enriched")]
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert any("SortMergeJoin" in line for line in plan)
        assert not [line for line in plan if any(x in line for x in ("SortMergeJoin", "Exchange hash", "Sort [")) and ("regexp" in line or "lower(" in line)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_streams_share_a_file_of_event_lines(spark, tmp_path):
    want = {(k if k else None, i): f"line\t{k}\t{i}" if i % 3 else "" for k in range(300) for i in range(5)}
    lines = spark.createDataFrame([(k, i, v) for (k, i), v in want.items()], "stream_id long, seq long, line string").repartition(7)
    path = f"file://{tmp_path}/lines"
    write_sse_lines(lines, path)
    assert len(list((tmp_path / "lines").glob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    number, got = {}, {}
    for r in sorted(sse_lines(spark, path, named=True).collect(), key=lambda r: r.seq):
        number[r.stream_id] = number.get(r.stream_id, -1) + 1
        got[(r.stream_id, number[r.stream_id])] = r.line
    assert got == want
