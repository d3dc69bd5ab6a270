"""Scalar functions over whole columns of the supplied tables, with the same expressions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classify as K
from millrace.functions import text as X
from millrace.functions import timing as T
from millrace.session import table

APP = "App"
NOW = "2024-01-20 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_JS_WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _add(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """A projection of one table: its key and computed columns, in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[c.alias(n) for n, c in columns().items()])

    run.__doc__ = f"{', '.join(sql)} of every row of {source}."
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {source}"


c = F.col
_odd_name = lambda: F.concat(F.initcap(c("p_name")), F.lit("® Dog Food (R) Formula "), c("p_brand"), F.lit("   recipe's"))
_odd_sql = "concat(upper(left(split_part(p_name,' ',1),1)), substr(split_part(p_name,' ',1),2), ' ', upper(left(split_part(p_name,' ',2),1)), substr(split_part(p_name,' ',2),2), '® Dog Food (R) Formula ', p_brand, ' ', chr(160), ' recipe''s')"
_key_sql = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{}}), '\(r\)|\(tm\)|\(c\)|®|™|©', '', 'g'),
 '\b(dog food|cat food|formula|recipe)\b', '', 'g'), '[^a-z0-9{_JS_WS}]', '', 'g'), '[{_JS_WS}]+', ' ', 'g'))"""

_add("f1_normalize_key", "part", "p_partkey", lambda: {"plain": X.normalize_key(c("p_name")), "odd": X.normalize_key(_odd_name())}, {"plain": _key_sql.replace("{}", "p_name"), "odd": _key_sql.replace("{}", _odd_sql)})
_add(
    "f2_pet_type", "part", "p_partkey",
    lambda: {"pet_type": X.detect_pet_type(c("p_name"), c("p_type"), F.when(c("p_partkey") % 3 == 0, F.array(F.lit("en:Dog-foods"), c("p_brand"))).when(c("p_partkey") % 3 == 1, F.array(F.lit("delicate"))))},
    {"pet_type": "CASE WHEN p_partkey % 3 = 0 THEN 'dog' WHEN p_partkey % 3 = 1 THEN 'cat' WHEN lower(p_name || ' ' || p_type) LIKE '%dog%' THEN 'dog' WHEN lower(p_name || ' ' || p_type) LIKE '%cat%' THEN 'cat' ELSE 'unknown' END"},
)
_wide = lambda: F.concat(c("p_name"), F.lit(" ("), c("p_type"), F.lit(" range) "), F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise(""))
_wide_sql = "concat(p_name, ' (', p_type, ' range) ', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END)"
_short_sql = rf"trim(regexp_replace({_wide_sql}, '[{_JS_WS}]*\(.*?\)', '', 'g'))"
_add(
    "f3_shorten", "part", "p_partkey", lambda: {"short": X.shorten(_wide())},
    {"short": rf"CASE WHEN length({_wide_sql}) <= 16 THEN {_wide_sql} WHEN length({_short_sql}) <= 16 THEN {_short_sql} WHEN len(string_split_regex({_short_sql}, '\s+')) > 2 THEN array_to_string(string_split_regex({_short_sql}, '\s+')[1:2], ' ') WHEN len(string_split_regex({_short_sql}, '\s+')) = 2 THEN string_split_regex({_short_sql}, '\s+')[1] ELSE {_short_sql} END"},
)
_add("f4_pill", "documents", "doc_id", lambda: {"pill": X.truncate_pill(c("text"))}, {"pill": "CASE WHEN length(text) <= 35 THEN text ELSE COALESCE(NULLIF(regexp_extract(left(text, 35), '(?s)^(.+) ', 1), ''), left(text, 35)) END"})
_add(
    "f5_two_sentences", "documents", "doc_id", lambda: {"verdict": X.two_sentences(c("text"), c("doc_id") % 2 == 0)},
    {"verdict": "CASE WHEN doc_id % 2 = 0 AND len(string_split(text, '. ')) > 2 THEN array_to_string(string_split(text, '. ')[1:2], '. ') || '.' ELSE text END"},
)
_add(
    "f6_review_count", "orders", "o_orderkey", lambda: {"reviews": X.review_count(c("o_custkey") * 37)},
    {"reviews": "CASE WHEN o_custkey = 0 THEN NULL WHEN o_custkey * 37 >= 1000 THEN CASE WHEN o_custkey * 37 % 1000 = 0 THEN CAST(o_custkey * 37 // 1000 AS VARCHAR) ELSE concat((o_custkey * 37 + 50) // 100 // 10, '.', (o_custkey * 37 + 50) // 100 % 10) END || 'K' ELSE CAST(o_custkey * 37 AS VARCHAR) END"},
)
_recall = lambda: F.when(c("p_partkey") % 4 == 0, "None known").when(c("p_partkey") % 4 == 1, "no recalls").when(c("p_partkey") % 4 == 2, "Nonesuch 2019").otherwise(c("p_name"))
_add(
    "f7_recall_clean", "part", "p_partkey", lambda: {"clean": X.recall_clean(_recall())},
    {"clean": r"regexp_matches(CASE p_partkey % 4 WHEN 0 THEN 'None known' WHEN 1 THEN 'no recalls' WHEN 2 THEN 'Nonesuch 2019' ELSE p_name END, '(?i)^(none|no recalls?)\b')"},
)
_add("f8_initials", "part", "p_partkey", lambda: {"initials": X.initials(c("p_name"))}, {"initials": "left(upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '')), 2)"})
_mail = lambda: F.concat(F.lower("c_mktsegment"), F.lit("@example.org"))
_add(
    "f9_display_name", "customer", "c_custkey",
    lambda: {"name": X.display_name(F.when(c("c_custkey") % 3 == 0, c("c_name")), F.when(c("c_custkey") % 3 == 1, c("c_mktsegment")), _mail())},
    {"name": "COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, split_part(lower(c_mktsegment) || '@example.org', '@', 1))"},
)
_add("f10_slug", "part", "p_partkey", lambda: {"slug": X.slug(_odd_name())}, {"slug": rf"lower(left(regexp_replace(regexp_replace({_odd_sql}, '[^a-zA-Z0-9{_JS_WS}]', '', 'g'), '[{_JS_WS}]+', '-', 'g'), 30))"})
_score = lambda: (1 + c("p_partkey") % 100).cast("int")
_tier_sql = "CASE WHEN {0} >= 85 THEN 'EXCELLENT' WHEN {0} >= 70 THEN 'GOOD' WHEN {0} >= 50 THEN 'AVERAGE' WHEN {0} >= 30 THEN 'BELOW AVERAGE' ELSE 'POOR' END"
_add(
    "f11_share_message", "part", "p_partkey", lambda: {"message": X.share_message(c("p_name"), _score(), K.score_tier(_score()), APP)},
    {"message": f"concat(p_name, ' scored ', 1 + p_partkey % 100, '/100 (', {_tier_sql.format('(1 + p_partkey % 100)')}, ') on {APP}!')"},
)
_product = lambda: {
    "product_name": F.when(c("p_partkey") % 5 > 0, c("p_name")).otherwise(""), "brand": c("p_brand"), "pet_type": F.lit(None).cast("string"), "ingredients_text": F.when(c("p_size") > 20, c("p_type")),
    "protein": F.when(c("p_size") % 2 == 0, c("p_size").cast("double")), "fat": c("p_size") / 4, "fiber": F.lit(None).cast("double"), "energy": (c("p_size") * 10).cast("double"),
    "nutriscore_grade": F.when(c("p_size") > 10, "b").otherwise(""), "nova_group": c("p_size") % 5,
}
_add(
    "f12_verified_text", "part", "p_partkey", lambda: {"block": X.verified_text(_product())},
    {"block": r"""concat_ws(chr(10), 'Product: ' || CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE 'Unknown' END, 'Brand: ' || p_brand, CASE WHEN p_size > 20 THEN chr(10) || 'Ingredients List:' || chr(10) || p_type END,
 CASE WHEN p_size % 2 = 0 THEN 'Protein: ' || p_size || 'g per 100g' END, 'Fat: ' || regexp_replace(CAST(CAST(p_size / 4 AS DOUBLE) AS VARCHAR), '\.0$', '') || 'g per 100g', 'Energy: ' || p_size * 10 || ' kcal per 100g',
 CASE WHEN p_size > 10 THEN 'Nutriscore Grade: B' END, CASE WHEN p_size % 5 <> 0 THEN 'NOVA Group: ' || p_size % 5 END)"""},
)
_fenced = lambda: F.when(c("event_id") % 2 == 0, F.concat(F.lit(" ```json\n"), c("props"), F.lit("\n``` "))).otherwise(F.concat(c("props"), F.lit("\n")))
_add("f13_fenced_json", "events", "event_id", lambda: {"k": F.get_json_object(X.strip_fence(_fenced()), "$.k").cast("int"), "clean": X.strip_fence(_fenced())}, {"k": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "clean": "props"})
_meta = lambda: F.when(c("c_custkey") % 3 == 0, F.to_json(F.struct(c("c_name").alias("full_name")))).when(c("c_custkey") % 3 == 1, F.to_json(F.struct(c("c_mktsegment").alias("name"), c("c_name").alias("picture")))).otherwise("{}")
_add(
    "f14_json_fallback", "customer", "c_custkey",
    lambda: {"display_name": F.coalesce(F.get_json_object(_meta(), "$.full_name"), F.get_json_object(_meta(), "$.name"), F.split_part(_mail(), F.lit("@"), F.lit(1))), "avatar": F.coalesce(F.get_json_object(_meta(), "$.avatar_url"), F.get_json_object(_meta(), "$.picture"))},
    {"display_name": "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE lower(c_mktsegment) END", "avatar": "CASE WHEN c_custkey % 3 = 1 THEN c_name END"},
)
_err = lambda: F.when(c("event_id") % 3 == 0, "Session expired. Please sign in.").when(c("event_id") % 3 == 1, "timeout")
_add(
    "f15_error_title", "events", "event_id", lambda: {"title": X.error_title(_err(), c("event_type")), "button": X.error_button(_err(), F.when(c("event_type") == "view", "history").otherwise("barcode"))},
    {"title": "CASE WHEN event_id % 3 = 0 THEN 'Session Expired' ELSE 'Couldn''t analyze this label' END", "button": "CASE WHEN event_id % 3 = 0 THEN 'Sign In Again' WHEN event_type = 'view' THEN 'Back to Home' ELSE 'Take Photo Instead' END"},
)
_add("f17_score_tier", "orders", "o_orderkey", lambda: {"tier": K.score_tier(F.when(c("o_orderkey") % 7 > 0, c("o_orderkey") % 101))}, {"tier": _tier_sql.format("(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 101 END)")})
_rate = lambda: (c("p_size") % 51) / 10
_add("f18_review_accent", "part", "p_partkey", lambda: {"accent": K.review_accent(_rate(), F.lit(5))}, {"accent": "CASE WHEN p_size % 51 / 10 >= 5 THEN 'excellent' WHEN p_size % 51 / 10 >= 5 * 0.8::DOUBLE THEN 'decent' WHEN p_size % 51 / 10 >= 5 * 0.6::DOUBLE THEN 'fair' ELSE 'concerning' END"})
_add(
    "f19_stars", "part", "p_partkey", lambda: {"stars": F.array_join(F.transform(K.stars(c("p_size") / 8), lambda x: x.cast("string")), ",")},
    {"stars": "array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i < floor(p_size / 8) THEN '1.0' WHEN i = floor(p_size / 8) AND p_size / 8 - floor(p_size / 8) >= 0.3::DOUBLE THEN '0.5' ELSE '0.0' END), ',')"},
)
_grade = lambda: F.substring("p_name", 1, 1)
_add(
    "f20_badges", "part", "p_partkey", lambda: {"nutriscore": K.nutriscore_color(F.upper(_grade())), "nova": K.nova_color(c("p_size") % 6)},
    {"nutriscore": "CASE left(p_name, 1) WHEN 'a' THEN '#1B8C3A' WHEN 'b' THEN '#85BB2F' WHEN 'c' THEN '#FECB02' WHEN 'd' THEN '#EE8100' WHEN 'e' THEN '#E63E11' ELSE 'gray' END", "nova": "CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'excellent' WHEN 2 THEN 'good' WHEN 3 THEN 'decent' WHEN 4 THEN 'bad' ELSE 'secondary' END"},
)
_pick = lambda key, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (c(key) % len(values) + 1).cast("int"))
_pick_sql = lambda key, *values: "CASE " + key + f" % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"
_add("f21_source_label", "part", "p_partkey", lambda: {"label": K.source_label(_pick("p_partkey", "verified", "enriched", "ai", "cached", "other", None))}, {"label": _pick_sql("p_partkey", "Verified Data", "AI + Verified", "AI Estimated", "Instant Result", "AI Estimated", "AI Estimated")})
_level = lambda: _pick("p_partkey", "safe", "caution", "dangerous", None)
_add(
    "f22_safety", "part", "p_partkey", lambda: {"label": K.safety_label(_level()), "color": K.safety_color(_level()), "pets": K.pet_label(_pick("p_size", "dog", "cat", None))},
    {"label": _pick_sql("p_partkey", "SAFE", "CAUTION", "DANGEROUS", "UNKNOWN"), "color": _pick_sql("p_partkey", "excellent", "decent", "concerning", "concerning"), "pets": _pick_sql("p_size", "dogs", "cats", "cats")},
)
_add("f23_age_label", "part", "p_partkey", lambda: {"age": K.age_label(_level())}, {"age": _pick_sql("p_partkey", "Safe", "Caution", "Avoid", "Avoid")})
_flag = lambda: F.when(c("l_returnflag") == "A", "good").when(c("l_returnflag") == "N", "neutral").when(c("l_returnflag") == "R", "bad")
_flag_sql = "CASE l_returnflag WHEN 'A' THEN 'good' WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'bad' END"
_add("f24_rating", "lineitem", "l_orderkey", lambda: {"l_linenumber": c("l_linenumber"), "dot": K.rating_dot(_flag()), "quality": K.quality_label(_flag())}, {"l_linenumber": "l_linenumber", "dot": f"COALESCE({_flag_sql}, 'neutral')", "quality": "CASE l_returnflag WHEN 'A' THEN 'Good ingredient' WHEN 'R' THEN 'Concerning ingredient' ELSE 'Neutral ingredient' END"})
_pro = lambda: c("c_acctbal") > 5000
_add(
    "f25_quota", "customer", "c_custkey", lambda: {"can_scan": K.can_scan(_pro(), c("c_custkey") % 6), "remaining": K.remaining_scans(_pro(), c("c_custkey") % 6)},
    {"can_scan": "c_acctbal > 5000 OR c_custkey % 6 < 3", "remaining": "CASE WHEN NOT c_acctbal > 5000 THEN greatest(0, 3 - c_custkey % 6) END"},
)
_add("f26_ring", "part", "p_partkey", lambda: {"ring": F.round(K.ring_offset(c("p_size"), 80.0), 6)}, {"ring": "round(2 * pi() * 80 * (1 - p_size / 100), 6)"})
_add("f27_level", "part", "p_partkey", lambda: {"dot": K.level_dot(_pick("p_partkey", "High", "moderate", "LOW", "odd", "", None))}, {"dot": _pick_sql("p_partkey", "good", "neutral", "decent", "neutral", None, None)})
_millis = lambda: F.unix_millis(c("ts").cast("timestamp"))
_digits = "0123456789abcdefghijklmnopqrstuvwxyz"
_base36 = " || ".join(f"substr('{_digits}', CAST(epoch_us(ts) // 1000 // {36**k} % 36 AS BIGINT) + 1, 1)" for k in range(7, -1, -1))
_add("f28_entry_id", "events", "event_id", lambda: {"id": X.entry_id(_millis())}, {"id": f"ltrim({_base36}, '0')"})
_falsy = lambda: F.element_at(F.array(*[F.lit('{"error": %s}' % x) for x in ("false", "0", "null", "0.0", '"false"', '"0"', "true", "7")]), (c("event_id") % 8 + 1).cast("int"))
_body = lambda: F.when(c("user_id") % 5 == 0, _falsy()).when(c("event_id") % 4 == 0, F.to_json(F.struct(c("event_type").alias("error")))).when(c("event_id") % 4 == 1, c("event_type")).when(c("event_id") % 4 == 2, "").otherwise(c("props"))
_add(
    "f29_error_message", "events", "event_id", lambda: {"message": X.error_message(_body(), F.lit(500) + c("event_id") % 5)},
    {"message": "CASE WHEN user_id % 5 = 0 AND event_id % 8 > 3 THEN ['false', '0', 'true', '7'][event_id % 8 - 3] WHEN user_id % 5 > 0 AND event_id % 4 < 2 THEN event_type ELSE concat('Analysis error (', 500 + event_id % 5, ')') END"},
)
_add("f30_upstream_status", "events", "event_id", lambda: {"status": X.upstream_status((400 + c("event_id") % 150).cast("int"))}, {"status": "CAST(CASE WHEN 400 + event_id % 150 >= 500 THEN 502 ELSE 400 + event_id % 150 END AS INTEGER)"})

_now = lambda: F.lit(NOW).cast("timestamp")
_ts = lambda: c("ts").cast("timestamp")
_ms_sql = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000)"
_add(
    "t1_relative_date", "events", "event_id", lambda: {"age": T.relative_date(_ts(), _now())},
    {"age": f"CASE WHEN {_ms_sql} < 60000 THEN 'Just now' WHEN {_ms_sql} < 3600000 THEN CAST(floor({_ms_sql} / 60000) AS BIGINT) || 'm ago' WHEN {_ms_sql} < 86400000 THEN CAST(floor({_ms_sql} / 3600000) AS BIGINT) || 'h ago' WHEN {_ms_sql} < 604800000 THEN CAST(floor({_ms_sql} / 86400000) AS BIGINT) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END"},
)
_add("t2_expires_at", "events", "event_id", lambda: {"expires": F.unix_micros(T.expires_at(_ts()))}, {"expires": "epoch_us(ts + INTERVAL 7 DAYS)"})
_add("t3_interval", "events", "event_id", lambda: {"window_end": F.unix_micros(_ts() + T.minutes((c("user_id") % 90).cast("int")))}, {"window_end": "epoch_us(ts + to_minutes(CAST(user_id % 90 AS BIGINT)))"})
_add("t5_elapsed", "events", "event_id", lambda: {"seconds": T.elapsed_seconds(F.lit("2024-01-01").cast("timestamp"), _ts()), "iso": F.date_format(_ts(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}, {"seconds": "round(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000) / 1000, 1)", "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"})
_dismissed = lambda: F.when(c("event_id") % 4 > 0, _ts())
_add("w6_cooldown", "events", "event_id", lambda: {"show": T.cooled_down(_dismissed(), _now())}, {"show": f"event_id % 4 = 0 OR {_ms_sql} > 7 * 86400000"})
_ms = lambda: (c("value") * 1000).cast("long")
_add(
    "st15_progress", "events", "event_id", lambda: {"status": T.progress_status(_ms())},
    {"status": "CASE WHEN trunc(value * 1000) >= 120000 THEN 'Analysis is taking too long. Please try again.' WHEN trunc(value * 1000) >= 25000 THEN 'Almost there...' WHEN trunc(value * 1000) >= 15000 THEN 'Still analyzing — complex ingredients take longer...' WHEN trunc(value * 1000) >= 8000 THEN 'Reading ingredients...' END"},
)
_end = lambda: F.timestamp_micros(F.unix_micros(_ts()) + (c("value") * 10_000_000).cast("long"))
_add(
    "st9_timeout", "events", "event_id", lambda: {"status": T.timed_out(F.when(c("event_type") == "error", "error").when(c("event_type") == "purchase", "complete").otherwise("running"), _ts(), _end())},
    {"status": "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'complete' WHEN floor(trunc(value * 10000000) / 1000) >= 120000 THEN 'error' ELSE 'running' END"},
)
_tag = lambda: _pick("p_partkey", "N/A", "Unknown", "", "12%", None)
_add("p8_clean", "part", "p_partkey", lambda: {"value": X.clean_placeholder(_tag())}, {"value": _pick_sql("p_partkey", None, None, None, "12%", None)})
_add(
    "j6_config_default", "part", "p_partkey", lambda: {"label": K.source_label(F.lower("p_type"))},
    {"label": "CASE lower(p_type) WHEN 'verified' THEN 'Verified Data' WHEN 'enriched' THEN 'AI + Verified' WHEN 'cached' THEN 'Instant Result' ELSE 'AI Estimated' END"},
)
