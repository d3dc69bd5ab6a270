"""Relational operators bound to the supplied tables: histories, caches, quotas, lists, anchored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.classify import can_scan
from millrace.operators import anchored as A
from millrace.operators import ingredients as G
from millrace.operators import lookup as L
from millrace.operators import search as S
from millrace.operators import tables as B
from millrace.operators.history import cap_newest, from_row, prepend_cap, to_row, top_per_user
from millrace.operators.parted import PartedTable
from millrace.session import table
from millrace.sources.shared import shared_path

NOW = "2024-01-20 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB twin."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("user_id"), c("o_orderdate").alias("date_scanned"), (1 + c("o_orderkey") % 100).cast("int").alias("overall_score"))


ENTRIES = "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS date_scanned, CAST(1 + o_orderkey % 100 AS INTEGER) AS overall_score FROM orders"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))


def _now():
    return F.lit(NOW).cast("timestamp")


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date_scanned DESC, id) AS INTEGER) AS position FROM ({ENTRIES})) WHERE position <= 50")
def s1_k1_user_history(spark, sf):
    return top_per_user(_entries(spark, sf), 50)


CACHE = f"""(SELECT user_id AS cache_key, arg_max(event_id, (ts, event_id)) AS analysis, CASE WHEN arg_max(event_id, (ts, event_id)) % 3 > 0 THEN 'verified' END AS data_source,
 max(ts) + INTERVAL 7 DAYS AS expires_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)"""


def _cache(spark, sf) -> DataFrame:
    last = B.latest_by(_events(spark, sf).where("event_type = 'purchase'").select("user_id", "ts", "event_id"), ["user_id"], c("ts"), c("event_id"))
    return last.select(
        c("user_id").alias("cache_key"), c("event_id").alias("analysis"), F.when(c("event_id") % 3 > 0, "verified").alias("data_source"), F.lit(None).cast("string").alias("opff_data"),
        (c("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"), c("ts").alias("updated_at"),
    )


@query(f"""SELECT k.cache_key, l.analysis, CASE WHEN l.cache_key IS NOT NULL THEN COALESCE(l.data_source, 'ai') END AS data_source, l.cache_key IS NOT NULL AS hit
 FROM (SELECT DISTINCT user_id AS cache_key FROM events) k LEFT JOIN (SELECT * FROM {CACHE} WHERE expires_at > TIMESTAMP '{NOW}') l USING (cache_key)""")
def s2_cache_lookup(spark, sf):
    keys = _events(spark, sf).select(c("user_id").alias("cache_key")).distinct()
    return L.cache_lookup(_cache(spark, sf), keys, _now()).drop("opff_data")


@query("SELECT * FROM customer WHERE c_custkey = 85")
def s3_profile(spark, sf):
    return L.one_row(table(spark, sf, "customer"), "c_custkey", F.lit(85))


CATALOG = "(SELECT p_partkey AS barcode, p_name AS product_name FROM part)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey * 2 AS scanned, b.product_name, b.barcode IS NOT NULL AS found FROM lineitem LEFT JOIN {CATALOG} b ON l_partkey * 2 = b.barcode""")
def s4_catalog_by_barcode(spark, sf):
    catalog = table(spark, sf, "part").select(c("p_partkey").alias("barcode"), c("p_name").alias("product_name"))
    scans = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") * 2).alias("scanned"))
    return scans.join(catalog, c("scanned") == c("barcode"), "left").select("l_orderkey", "l_linenumber", "scanned", "product_name", c("barcode").isNotNull().alias("found"))


@query("""SELECT s.n AS term, min(p_partkey) AS barcode FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS n FROM part) s JOIN part ON list_contains(string_split(p_name, ' '), s.n) GROUP BY s.n""")
def s5_catalog_search(spark, sf):
    """First product of a token search; products rank by key, since no remote ranking is defined."""
    part = table(spark, sf, "part")
    tokens = part.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"))
    return tokens.join(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term")).distinct(), "term").groupBy("term").agg(F.min("p_partkey").alias("barcode"))


@query("""SELECT term, CAST(position AS INTEGER) AS position, barcode FROM (SELECT term, barcode, row_number() OVER (PARTITION BY term ORDER BY barcode) AS position FROM (
  SELECT DISTINCT s.n AS term, p_partkey AS barcode FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS n FROM part) s JOIN part ON list_contains(string_split(p_name, ' '), s.n)))
 WHERE position <= 5 AND term <> ''""")
def s5_search_postings(spark, sf):
    """First five products of each token by the stored postings, which are written once and then looked up."""
    part, path = table(spark, sf, "part"), shared_path(spark, "postings")
    S.write_postings(part, path, "p_partkey", "p_name")
    terms = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"))
    return S.search(terms, path).withColumnRenamed("code", "barcode")


@query("SELECT event_id, json_extract_string(props, '$.k') AS saved, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s6_kv_documents(spark, sf):
    """Documents written as JSON text and parsed again; what does not parse is null."""
    saved = F.to_json(F.struct(F.from_json("props", "k long").alias("analysis"), c("event_type").alias("dataSource")))
    back = F.from_json(saved, "analysis struct<k: long>, dataSource string")
    return table(spark, sf, "events").select("event_id", back["analysis"]["k"].cast("string").alias("saved"), back["analysis"]["k"].alias("k"))


HIST_BASE = f"(SELECT id, user_id, overall_score FROM ({ENTRIES}) WHERE id % 4 < 3)"


@query(f"""WITH base AS {HIST_BASE}, ch AS (SELECT id, user_id, CAST(overall_score + 1 AS INTEGER) AS overall_score FROM ({ENTRIES}) WHERE id % 4 > 1)
SELECT COALESCE(ch.id, base.id) AS id, COALESCE(ch.user_id, base.user_id) AS user_id, COALESCE(ch.overall_score, base.overall_score) AS overall_score FROM base FULL JOIN ch ON base.id = ch.id AND base.user_id = ch.user_id""")
def s8_history_upsert(spark, sf):
    every = _entries(spark, sf)
    base = every.where("id % 4 < 3").select("id", "user_id", "overall_score")
    old = every.where("id % 4 > 1").select("id", "user_id", (c("overall_score") * 0).cast("int").alias("overall_score"), F.lit(1).alias("v"))
    new = every.where("id % 4 > 1").select("id", "user_id", (c("overall_score") + 1).cast("int").alias("overall_score"), F.lit(2).alias("v"))
    return B.upsert(base, old.unionByName(new), ["id", "user_id"], "v")


_PARTED = f"""SELECT id, user_id, CAST(CASE WHEN o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAYS FROM orders) THEN overall_score + 1 ELSE overall_score END AS INTEGER) AS overall_score
 FROM ({ENTRIES}) JOIN orders ON o_orderkey = id"""


@query(_PARTED)
def s8_upsert_parts(spark, sf):
    """A history in parts; the entries of its last thirty days come again, and only their parts are written anew."""
    every = _entries(spark, sf)
    held = every.select("id", "user_id", "overall_score").withColumn("v", F.lit(0))
    history = PartedTable(spark, shared_path(spark, "history"), held.drop("v").schema, ("id", "user_id"), buckets=16)
    history.upsert(held, "v")
    last = every.agg(F.max("date_scanned").alias("last"))
    late = every.join(last, c("date_scanned") >= c("last") - F.make_dt_interval(F.lit(30)), "left_semi")
    history.upsert(late.select("id", "user_id", (c("overall_score") + 1).cast("int").alias("overall_score"), F.lit(1).alias("v")), "v")
    return history.rows()


@query("""WITH b AS (SELECT user_id AS cache_key, min(event_id) AS analysis, count(*) AS hit_count FROM events WHERE event_type = 'view' GROUP BY user_id),
 n AS (SELECT user_id AS cache_key, arg_max(event_id, (ts, event_id)) AS analysis FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT COALESCE(n.cache_key, b.cache_key) AS cache_key, COALESCE(n.analysis, b.analysis) AS analysis, CASE WHEN b.cache_key IS NULL THEN 0 ELSE b.hit_count END AS hit_count FROM b FULL JOIN n ON b.cache_key = n.cache_key""")
def s9_cache_upsert(spark, sf):
    """A conflict resets the analysis; hit counters survive."""
    events = _events(spark, sf)
    base = events.where("event_type = 'view'").groupBy(c("user_id").alias("cache_key")).agg(F.min("event_id").alias("analysis"), F.count(F.lit(1)).alias("hit_count"))
    new = events.where("event_type = 'purchase'").select(c("user_id").alias("cache_key"), c("event_id").alias("analysis"), F.lit(0).cast("long").alias("hit_count"), F.struct("ts", "event_id").alias("v"))
    return B.upsert(base, new, ["cache_key"], "v", kept=("hit_count",))


@query(f"""WITH v AS (SELECT user_id AS cache_key, arg_max(event_id, (ts, event_id)) AS analysis, max(ts) + INTERVAL 7 DAYS AS expires_at, count(*) AS hit_count FROM events WHERE event_type = 'view' GROUP BY user_id),
 n AS (SELECT cache_key, analysis, expires_at FROM {CACHE})
SELECT * FROM (SELECT COALESCE(n.cache_key, v.cache_key) AS cache_key, COALESCE(n.analysis, v.analysis) AS analysis, COALESCE(n.expires_at, v.expires_at) AS expires_at,
 CASE WHEN v.cache_key IS NULL THEN 0 ELSE v.hit_count END AS hit_count FROM v FULL JOIN n ON v.cache_key = n.cache_key) WHERE expires_at >= TIMESTAMP '{NOW}'""")
def s9_st12_cache_parts(spark, sf):
    """A cache in parts by key and day of expiry: entries of views, purchases that replace them, then the clean-up."""
    events = _events(spark, sf)
    entry = lambda kind, n, v: events.where(c("event_type") == kind).groupBy(c("user_id").alias("cache_key")).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("analysis"), (F.max("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"), n.alias("hit_count")).withColumn("v", F.lit(v))
    views, purchases = entry("view", F.count(F.lit(1)), 0), entry("purchase", F.max(F.lit(0)).cast("long"), 1)
    cache = PartedTable(spark, shared_path(spark, "cache"), views.drop("v").schema, ("cache_key",), buckets=4, expires="expires_at")
    cache.upsert(views, "v")
    cache.upsert(purchases, "v", kept=("hit_count",))
    cache.delete_expired(_now())
    return cache.rows()


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE lower(c_mktsegment) END AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'google' ELSE 'email' END AS provider, 0 AS scan_count, false AS is_pro FROM customer")
def s10_profile_insert(spark, sf):
    """Profiles of new users from their metadata, with the table's defaults."""
    users = table(spark, sf, "customer").select(c("c_custkey").alias("id"), F.lower("c_mktsegment").alias("mail"), F.when(c("c_custkey") % 3 == 0, F.to_json(F.struct(c("c_name").alias("full_name")))).otherwise("{}").alias("meta"))
    name = F.coalesce(F.get_json_object("meta", "$.full_name"), F.get_json_object("meta", "$.name"), F.split_part(F.concat("mail", F.lit("@example.org")), F.lit("@"), F.lit(1)))
    return users.select("id", name.alias("display_name"), F.when(c("id") % 3 == 0, "google").otherwise("email").alias("provider"), F.lit(0).alias("scan_count"), F.lit(False).alias("is_pro"))


@query("SELECT c_custkey, COALESCE(u.v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) u ON o_custkey = c_custkey")
def s11_update_latest(spark, sf):
    updates = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), c("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return B.update_latest(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), updates, "c_custkey", "c_acctbal", "v")


@query("SELECT c_custkey, COALESCE(u.v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1) u ON o_custkey = c_custkey")
def s11_update_parts(spark, sf):
    """The same last-writer update on a table in parts."""
    held = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    updates = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), c("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    profiles = PartedTable(spark, shared_path(spark, "profiles"), held.schema, ("c_custkey",), buckets=16)
    profiles.upsert(held.withColumn("v", F.lit(0)), "v")
    profiles.update(updates, "c_acctbal", "v")
    return profiles.rows()


@query(f"SELECT * FROM ({ENTRIES}) WHERE user_id <> 85")
def s15_clear_history(spark, sf):
    return B.delete_where(_entries(spark, sf), c("user_id") == 85)


@query(f"SELECT id, user_id, date_scanned AS \"dateScanned\", overall_score AS \"overallScore\" FROM ({ENTRIES})")
def p2_row_to_entry(spark, sf):
    return from_row(_entries(spark, sf))


@query(f"SELECT id, user_id, date_scanned, overall_score FROM ({ENTRIES})")
def p1_entry_to_row(spark, sf):
    return to_row(from_row(_entries(spark, sf)))


@query("SELECT p_name AS \"productName\", p_brand AS brand, CAST(p_size AS INTEGER) AS \"novaGroup\", left(repeat(p_type, 3000), 10000) AS \"ingredientsText\" FROM part")
def p3_sanitize(spark, sf):
    part = table(spark, sf, "part")
    return G.sanitize(part.select(c("p_name").alias("productName"), c("p_brand").alias("brand"), c("p_partkey").alias("secret"), c("p_size").alias("novaGroup"), F.repeat("p_type", F.lit(3000)).alias("ingredientsText")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE p_brand END AS "productName", COALESCE(p_brand, '') AS brand, CAST(p_partkey AS VARCHAR) AS barcode, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0::DOUBLE END AS protein,
 p_size % 5 = 0 AS energy_unit_known, CASE WHEN p_size % 5 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size * 4 AS DOUBLE) END AS energy, CASE WHEN p_size % 2 = 0 THEN 'a' END AS "nutriscoreGrade",
 CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END AS n_ingredients, CASE WHEN p_size % 3 > 0 THEN concat_ws('|', p_brand, '', CAST(p_size AS VARCHAR), '', p_type, 'none') ELSE '' END AS ingredients,
 CASE WHEN p_size % 4 = 0 THEN 'front' WHEN p_size % 4 = 1 THEN 'image' END AS "imageUrl" FROM part""")
def p4_normalize_product(spark, sf):
    raw = {
        "product_name": F.when(c("p_partkey") % 3 > 0, c("p_name")).otherwise(""), "product_name_en": c("p_brand"), "brands": c("p_brand"), "categories": c("p_type"), "categories_tags": F.lit(None).cast("array<string>"),
        "code": F.lit(""), "_id": c("p_partkey").cast("string"), "proteins_100g": F.when(c("p_size") % 2 == 0, c("p_size").cast("double")), "proteins": F.lit(0.0),
        "energy-kcal_100g": F.when(c("p_size") % 5 == 0, c("p_size").cast("double")), "energy_100g": (c("p_size") * 4).cast("double"), "fat_100g": F.lit(1.0), "fiber": F.lit(2.0),
        "nutriscore_grade": F.lit(""), "nutrition_grades": F.when(c("p_size") % 2 == 0, "a"), "nova_group": c("p_size"),
        "image_url": F.when(c("p_size") % 4 == 1, "image").otherwise(""), "image_front_url": F.when(c("p_size") % 4 == 0, "front").when(c("p_size") % 4 == 2, ""),
        "ingredients": F.when(c("p_size") % 3 > 0, F.array(
            F.struct(c("p_brand").alias("id"), F.lit(None).cast("string").alias("text"), c("p_size").alias("percent_estimate")),
            F.struct(F.lit(None).cast("string").alias("id"), c("p_type").alias("text"), F.lit(None).cast("int").alias("percent_estimate")),
        )),
    }
    done = G.normalize_product(raw)
    listed = F.array_join(F.flatten(F.transform(done["ingredients"], lambda x: F.array(x["id"], x["text"], F.coalesce(x["percent"].cast("long").cast("string"), F.lit("none"))))), "|")
    fields = [done[k].alias(k) for k in ("productName", "brand", "barcode", "protein", "energy_unit_known", "energy", "nutriscoreGrade", "imageUrl")]
    return table(spark, sf, "part").select("p_partkey", *fields, F.size(done["ingredients"]).alias("n_ingredients"), listed.alias("ingredients"))


@query("SELECT event_id, event_id % 12 IN (0, 5, 7, 8, 9) AND event_id % 103 BETWEEN 1 AND 100 AS valid FROM events")
def p5_valid_analysis(spark, sf):
    """Kinds of documents: good, error, empty name, text score, no JSON, empty error, null name; errors false, 0, null, "false", "0"."""
    score = (c("event_id") % 103).cast("string")
    kinds = [
        F.concat(F.lit('{"productName": "x", "overallScore": '), score, F.lit("}")), F.concat(F.lit('{"error": "no", "productName": "x", "overallScore": '), score, F.lit("}")),
        F.concat(F.lit('{"productName": "", "overallScore": '), score, F.lit("}")), F.concat(F.lit('{"productName": "x", "overallScore": "'), score, F.lit('"}')), F.concat(F.lit("{broken "), score),
        F.concat(F.lit('{"error": "", "productName": "y", "overallScore": '), score, F.lit("}")), F.concat(F.lit('{"productName": null, "overallScore": '), score, F.lit("}")),
        *[F.concat(F.lit(f'{{"error": {e}, "productName": "y", "overallScore": '), score, F.lit("}")) for e in ("false", "0", "null", '"false"', '"0"')],
    ]
    return table(spark, sf, "events").select("event_id", G.is_valid_analysis(F.element_at(F.array(*kinds), (c("event_id") % 12 + 1).cast("int"))).alias("valid"))


@query("""SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 405 WHEN user_id % 11 = 0 THEN 401 WHEN event_type = 'signup' THEN 400 WHEN event_id % 4 = 3 THEN 400
 WHEN event_id % 4 IN (0, 2) AND user_id % 5 = 0 THEN 400 WHEN event_id % 4 = 1 AND user_id % 3 = 0 THEN 400 WHEN event_id % 4 = 2 AND user_id % 7 = 0 THEN 400 WHEN user_id % 5 > 0 AND user_id % 5 * 2000000 > 7000000 THEN 413 ELSE 200 END AS INTEGER) AS status FROM events""")
def p6_request_status(spark, sf):
    e, u = c("event_id"), c("user_id")
    r = {
        "method": F.when(c("event_type") == "error", "GET").otherwise("POST"), "auth": F.when(u % 11 == 0, "Bearer ").otherwise("Bearer x"), "body_valid": c("event_type") != "signup",
        "mode": F.element_at(F.array(*map(F.lit, ("photo", "verified", "human_food", "other"))), (e % 4 + 1).cast("int")), "image_length": u % 5 * 2_000_000,
        "product_valid": u % 3 != 0, "pet": F.when(u % 7 > 0, "dog"),
    }
    return table(spark, sf, "events").select("event_id", G.request_status(r).alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 'barcode is required' WHEN event_id % 3 = 1 AND user_id % 4 = 0 THEN 'image is required' WHEN event_id % 3 = 2 AND (user_id % 4 = 0 OR user_id % 5 = 0) THEN 'image and pet type are required' END AS problem FROM events""")
def p7_start_error(spark, sf):
    e, u = c("event_id"), c("user_id")
    mode = F.element_at(F.array(*map(F.lit, ("barcode", "photo", "human_food"))), (e % 3 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", G.start_error(mode, F.when(u % 2 > 0, "4006").otherwise(""), F.when(u % 4 > 0, "aa"), F.when(u % 5 > 0, "cat")).alias("problem"))


def _nutrition() -> dict:
    s = c("p_size")
    pct = F.when(s % 4 == 0, "N/A").when(s % 4 == 1, F.concat(s.cast("string"), F.lit("%"))).when(s % 4 == 2, "")
    return {
        "primary_protein": F.when(s % 3 > 0, c("p_name")).otherwise(""), "grain_free": F.when(s % 5 > 0, s % 2 == 0), "life_stage": F.when(s % 3 == 0, "Unknown").otherwise("Adult"), "calories": F.when(s % 7 == 0, "N/A").otherwise("380"),
        "protein_percent": pct, "protein_level": F.lit("high"), "fat_percent": pct, "fat_level": F.lit("low"), "fiber_percent": pct,
    }


@query("""SELECT p_partkey, concat_ws(';', 'Protein=' || CASE WHEN p_size % 4 = 1 THEN p_size || '%' ELSE '-' END || '/' || CASE WHEN p_size % 4 IN (0, 1) THEN 'high' ELSE '-' END, 'Calories=' || CASE WHEN p_size % 7 = 0 THEN '-' ELSE '380' END || '/-',
 'Fat=' || CASE WHEN p_size % 4 = 1 THEN p_size || '%' ELSE '-' END || '/' || CASE WHEN p_size % 4 IN (0, 1) THEN 'low' ELSE '-' END, 'Life Stage=' || CASE WHEN p_size % 3 = 0 THEN '-' ELSE 'Adult' END || '/-', 'Fiber=' || CASE WHEN p_size % 4 = 1 THEN p_size || '%' ELSE '-' END || '/-',
 'Grain Free=' || CASE WHEN p_size % 5 = 0 THEN '-' WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END || '/-') AS grid FROM part""")
def p9_nutrition_grid(spark, sf):
    shown = F.transform(G.nutrition_grid(_nutrition()), lambda x: F.concat(x["label"], F.lit("="), F.coalesce(x["value"], F.lit("-")), F.lit("/"), F.coalesce(x["qualifier"], F.lit("-"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(shown, ";").alias("grid"))


@query("""SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 3 > 0 THEN 'Protein: ' || p_name END, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'Grain Free: Yes' ELSE 'Grain Free: No' END,
 CASE WHEN p_size % 3 > 0 THEN 'Life Stage: Adult' END, CASE WHEN p_size % 7 > 0 THEN 'Calories: 380' END) AS stats FROM part""")
def p10_quick_stats(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(G.first_n(G.quick_stats(_nutrition()), 4), ";").alias("stats"))


@query(f"SELECT * FROM ({ENTRIES}) WHERE user_id = 85")
def p11_row_access(spark, sf):
    return L.visible_to(_entries(spark, sf), "user_id", F.lit(85))


RATINGS = """(SELECT l_orderkey, list(CASE l_returnflag WHEN 'A' THEN 'good' WHEN 'N' THEN 'neutral' WHEN 'R' THEN 'bad' END ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS ratings FROM lineitem GROUP BY l_orderkey)"""


def _ratings(spark, sf) -> DataFrame:
    rating = F.when(c("l_returnflag") == "A", "good").when(c("l_returnflag") == "N", "neutral").when(c("l_returnflag") == "R", "bad")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", rating.alias("r")))).alias("x"))
    return lines.select("l_orderkey", F.transform("x", lambda x: x["r"]).alias("ratings"))


@query(f"""SELECT l_orderkey, CASE WHEN ratings[1] <> 'bad' THEN array_to_string(ratings, ',') END AS toxics, CASE WHEN l_orderkey % 3 > 0 THEN array_to_string(ratings[1:4], ',') END AS benefits FROM {RATINGS}""")
def p12_visible_lists(spark, sf):
    r = _ratings(spark, sf)
    named = F.transform("ratings", lambda x: F.when(x == "bad", "None").otherwise(x))
    toxics = F.transform(G.visible_toxics(named), lambda x: F.when(x == "None", "bad").otherwise(x))
    return r.select("l_orderkey", F.array_join(toxics, ",").alias("toxics"), F.array_join(G.visible_benefits(c("ratings"), F.when(c("l_orderkey") % 3 == 0, "dangerous")), ",").alias("benefits"))


@query(f"SELECT l_orderkey, ratings[1] <> 'good' AND l_orderkey % 4 > 0 AS shown FROM {RATINGS}")
def p13_shows_alternatives(spark, sf):
    return _ratings(spark, sf).select("l_orderkey", G.shows_alternatives(c("ratings")[0], F.when(c("l_orderkey") % 4 > 0, c("ratings"))).alias("shown"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def j1_unsynced(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT event_id, user_id, CASE WHEN user_id % 10 = 3 THEN user_id - 3 ELSE user_id END AS canonical FROM events")
def j2_alias(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id")
    aliases = events.where("user_id % 10 = 3").select(c("user_id").alias("alias"), (c("user_id") - 3).alias("target")).distinct()
    return L.resolve_alias(events, aliases, "user_id")


@query("""WITH cat AS (SELECT min(p_partkey) AS code, p_name FROM part WHERE p_partkey % 50 > 0 GROUP BY p_name)
SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(b.p_partkey, a.code, f.code) AS product_code, CASE WHEN COALESCE(b.p_partkey, a.code, f.code) IS NULL THEN 'ai' ELSE 'enriched' END AS data_source
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN l_partkey END AS bar, x.p_name AS full_name, CASE WHEN l_partkey % 4 = 1 THEN x.p_name ELSE 'nothing' END AS part_name, l_partkey % 4 = 3 AS lost FROM lineitem JOIN part x ON l_partkey = x.p_partkey)
LEFT JOIN part b ON bar = b.p_partkey LEFT JOIN cat a ON part_name = a.p_name LEFT JOIN cat f ON full_name = f.p_name AND NOT lost AND l_orderkey % 7 > 1""")
def j3_enrich(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part, c("l_partkey") == c("p_partkey"))
    scans = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_partkey") % 4 == 0, c("l_partkey")).alias("bar"), F.when(c("l_orderkey") % 7 == 0, "").when(c("l_orderkey") % 7 > 1, F.when(c("l_partkey") % 4 == 3, "lost").otherwise(c("p_name"))).alias("full_name"),
        F.when(c("l_partkey") % 4 == 1, c("p_name")).otherwise("nothing").alias("part_name"),
    )
    catalog = part.select(c("p_partkey").alias("barcode"), F.when(c("p_partkey") % 50 > 0, c("p_name")).alias("product_name"))
    return L.enrich(scans, catalog, "bar", "full_name", "part_name").select("l_orderkey", "l_linenumber", "l_partkey", "product_code", "data_source")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'memory' WHEN c_custkey % 4 = 0 THEN 'local' WHEN o_custkey IS NOT NULL THEN 'shared' ELSE 'expired' END AS layer,
 CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 WHEN c_custkey % 4 = 0 THEN c_custkey * 3 ELSE o_custkey END AS result FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def j4_layered(spark, sf):
    keys = table(spark, sf, "customer").select("c_custkey")
    memory = keys.where("c_custkey % 3 = 0").withColumn("result", c("c_custkey") * 2)
    local = keys.where("c_custkey % 4 = 0").withColumn("result", c("c_custkey") * 3)
    shared = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), c("o_custkey").alias("result")).distinct()
    return L.layered(keys, [("memory", memory), ("local", local), ("shared", shared)], "c_custkey", "result")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j5_cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0")
    return B.cascade_delete({"history": (table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}, gone, "c_custkey")["history"]


@query(f"""SELECT l_orderkey, good, neutral, bad, total, concat_ws(',', CASE WHEN good > 0 THEN good || ' Good' END, CASE WHEN neutral > 0 THEN neutral || ' Neutral' END, CASE WHEN bad > 0 THEN bad || ' Concerning' END) AS labels, CAST(good AS DOUBLE) / total AS good_share
FROM (SELECT l_orderkey, CAST(len(list_filter(ratings, lambda x: x = 'good')) AS INTEGER) AS good, CAST(len(list_filter(ratings, lambda x: x = 'neutral')) AS INTEGER) AS neutral, CAST(len(list_filter(ratings, lambda x: x = 'bad')) AS INTEGER) AS bad, CAST(len(ratings) AS INTEGER) AS total FROM {RATINGS})""")
def a1_rating_shares(spark, sf):
    r = _ratings(spark, sf).select("l_orderkey", G.rating_shares(c("ratings")).alias("s"))
    return r.select("l_orderkey", "s.good", "s.neutral", "s.bad", "s.total", F.array_join(F.transform("s.segments", lambda x: x["label"]), ",").alias("labels"), (c("s.good") / c("s.total")).alias("good_share"))


@query(f"SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 30 ELSE len(ratings) END - least(3, len(ratings)) AS INTEGER) AS hidden FROM {RATINGS}")
def a2_hidden_count(spark, sf):
    return _ratings(spark, sf).select("l_orderkey", G.hidden_count(c("ratings"), G.first_n(c("ratings"), 3), F.when(c("l_orderkey") % 2 == 0, 30)).alias("hidden"))


@query(f"""SELECT b.cache_key, b.analysis, CAST(100 + COALESCE(n, 0) AS BIGINT) AS hit_count, epoch_us(l) AS last_hit FROM {CACHE} b LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS l FROM events WHERE event_type = 'view' GROUP BY user_id) h ON h.user_id = b.cache_key""")
def a3_hit_counter(spark, sf):
    cache = _cache(spark, sf).select("cache_key", "analysis", F.lit(100).alias("hit_count"), F.lit(None).cast("timestamp").alias("last_hit_at"))
    hits = _events(spark, sf).where("event_type = 'view'").select(c("user_id").alias("cache_key"), "ts")
    return L.hit_counts(cache, hits, "cache_key", "ts").select("cache_key", "analysis", "hit_count", F.unix_micros("last_hit_at").alias("last_hit"))


@query("""SELECT c_custkey, COALESCE(n, 0) AS scan_count, c_acctbal > 5000 OR COALESCE(n, 0) < 3 AS can_scan FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'signup' AND NOT c_acctbal > 5000 AND event_type <> 'view' GROUP BY user_id) ON user_id = c_custkey""")
def a4_scan_counter(spark, sf):
    """Finished scans (errors and cache hits too) of users who are not pro, outside history mode."""
    users = table(spark, sf, "customer").select("c_custkey", (c("c_acctbal") > 5000).alias("pro"))
    scans = table(spark, sf, "events").select(c("user_id").alias("c_custkey"), (c("event_type") != "signup").alias("done"), F.when(c("event_type") == "view", "history").otherwise("photo").alias("mode"))
    counted = users.join(scans, "c_custkey", "left").groupBy("c_custkey", "pro").agg(F.count_if(c("done") & ~c("pro") & (c("mode") != "history")).alias("scan_count"))
    return counted.select("c_custkey", "scan_count", can_scan(c("pro"), c("scan_count")).alias("can_scan"))


@query(f"SELECT count(*) AS n FROM {CACHE} WHERE expires_at < TIMESTAMP '{NOW}'")
def a5_affected(spark, sf):
    return B.affected(_cache(spark, sf), c("expires_at") < _now())


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS whole FROM conversations GROUP BY conv_id")
def a6_ordered_fold(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("whole"))


def anchors_sql(gap: str, op: str) -> str:
    """Anchors of each user by recursion: the next is the first event after the gap."""
    return f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS tm FROM events),
 anchor AS (SELECT user_id, min(tm) AS ws FROM ev GROUP BY user_id UNION ALL SELECT a.user_id, min(e.tm) FROM anchor a JOIN ev e ON e.user_id = a.user_id AND e.tm {op} a.ws + {gap} GROUP BY a.user_id),
 placed AS (SELECT ev.user_id AS key, event_id AS id, tm AS "at", max(ws) AS window_start FROM ev JOIN anchor a ON a.user_id = ev.user_id AND ws <= tm GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY key, window_start ORDER BY "at", id) AS rank FROM placed)"""


@query(f"{anchors_sql('86400000000', '>')} SELECT *, rank <= 2 AS allowed FROM ranked")
def w1_admission(spark, sf):
    return A.admit(table(spark, sf, "events"), "user_id", "ts", "event_id", most=2, minutes=1440)


@query(f"{anchors_sql('21600000000', '>=')} SELECT *, rank = 1 AS accepted FROM ranked")
def w2_suppress_repeats(spark, sf):
    return A.suppress_repeats(table(spark, sf, "events"), "user_id", "ts", "event_id", 21_600_000_000)


@query(f"{anchors_sql('21600000000', '>=')} SELECT *, rank = 1 AS accepted, rank = 1 OR row_number() OVER (PARTITION BY key ORDER BY \"at\" DESC, id DESC) = 1 AS emitted FROM ranked")
def w3_throttle_leading(spark, sf):
    return A.throttle_leading(table(spark, sf, "events"), "user_id", "ts", "event_id", 21_600_000_000)


#: Each emission finds the next by recursion: what came within the gap gives a trailing one, else the next event leads.
_TRAILING = """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 emitted AS (SELECT user_id AS key, event_id AS id, tm AS emitted_at, FALSE AS "trailing", n FROM ev WHERE n = 1
 UNION ALL SELECT m.key, arg_max(ev.event_id, ev.n), CASE WHEN min(ev.tm) < m.emitted_at + 21600000000 THEN m.emitted_at + 21600000000 ELSE min(ev.tm) END, min(ev.tm) < m.emitted_at + 21600000000, max(ev.n)
 FROM emitted m JOIN ev ON ev.user_id = m.key AND ev.n > m.n AND (ev.n = m.n + 1 OR ev.tm < m.emitted_at + 21600000000) GROUP BY m.key, m.emitted_at, m.n)
 SELECT key, id, emitted_at, "trailing" FROM emitted"""


@query(_TRAILING)
def w4_throttle_trailing(spark, sf):
    return A.throttle_trailing(table(spark, sf, "events"), "user_id", "ts", "event_id", 21_600_000_000)


@query(f"{anchors_sql('2000000', '>=')} SELECT *, rank = 1 AS accepted FROM ranked")
def w5_reentry_lockout(spark, sf):
    return A.suppress_repeats(table(spark, sf, "events"), "user_id", "ts", "event_id", 2_000_000)


MERGE = f"""SELECT id, user_id, date_scanned, overall_score, CAST(src AS INTEGER) AS src FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_scanned DESC, src, id) AS p FROM (
 SELECT *, 1 AS src FROM ({ENTRIES}) WHERE id % 3 <> 0 UNION ALL SELECT *, 0 AS src FROM ({ENTRIES}) WHERE id % 3 = 0)) WHERE p <= 5"""


@query(MERGE)
def k2_merge_all_users(spark, sf):
    every = _entries(spark, sf)
    remote, local = every.where("id % 3 <> 0"), every.where("id % 3 <> 1")
    unsynced = local.join(remote.select("id"), "id", "left_anti")
    return cap_newest(unsynced.withColumn("src", F.lit(0)).unionByName(remote.withColumn("src", F.lit(1))), 5)


@query(f"SELECT id, user_id, position FROM (SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS INTEGER) AS position FROM ({ENTRIES})) WHERE position <= 10")
def k3_prepend_cap(spark, sf):
    return prepend_cap(_entries(spark, sf), "user_id", "id", 10).select("id", "user_id", "position")


@query("""SELECT user_id, event_type, last_id, CAST(position AS INTEGER) AS position, position > 3 AS evicted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, last_id DESC) AS position
 FROM (SELECT user_id, event_type, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2))""")
def k4_recency_list(spark, sf):
    listed = B.recency_list(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["event_type"], ["user_id"], [c("ts"), c("event_id")], 3)
    return listed.select("user_id", "event_type", c("event_id").alias("last_id"), "position", "evicted")


@query(f"""SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey % 3 = 0 THEN ratings[1:3] WHEN l_orderkey % 3 = 1 THEN ratings ELSE ratings[1:5] END, ',') AS shown FROM {RATINGS}""")
def k5_prefixes(spark, sf):
    r = _ratings(spark, sf)
    return r.select("l_orderkey", F.array_join(G.visible_ingredients(c("ratings"), c("l_orderkey") % 3 > 0, c("l_orderkey") % 3 == 1), ",").alias("shown"))


@query("SELECT user_id AS cache_key, count(*) AS hit_count, CAST(row_number() OVER (ORDER BY count(*) DESC, user_id) AS INTEGER) AS popularity FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY 3 LIMIT 20")
def k6_most_hit(spark, sf):
    """The twenty most hit keys; ranked after the cut, so one small task numbers them."""
    hits = table(spark, sf, "events").where("event_type = 'view'").groupBy(c("user_id").alias("cache_key")).agg(F.count(F.lit(1)).alias("hit_count"))
    top = hits.orderBy(F.desc("hit_count"), "cache_key").limit(20)
    return top.withColumn("popularity", F.row_number().over(Window.orderBy(F.desc("hit_count"), "cache_key")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '$monthly' WHEN o_orderkey % 3 = 1 THEN 'plan' END AS package FROM orders""")
def k7_first_match(spark, sf):
    k = c("o_orderkey") % 3
    p = lambda kind, ident: F.struct(F.lit(kind).alias("type"), F.lit(ident).alias("identifier"))
    offers = F.when(k == 0, F.array(p("WEEKLY", "w"), p("CUSTOM", "$monthly"), p("MONTHLY", "later"))).when(k == 1, F.array(p("MONTHLY", "plan"))).otherwise(F.array(p("ANNUAL", "a")))
    return table(spark, sf, "orders").select("o_orderkey", G.first_match(offers, "MONTHLY", "$monthly")["identifier"].alias("package"))


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def u1_bag_union(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query(f"SELECT l_orderkey, array_to_string(list_concat(['bad'], list_filter(ratings, lambda x: x <> 'bad')), ',') AS moved FROM {RATINGS}")
def u2_move_to_front(spark, sf):
    return _ratings(spark, sf).select("l_orderkey", F.array_join(F.concat(F.array(F.lit("bad")), F.filter("ratings", lambda x: x != "bad")), ",").alias("moved"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def u3_membership(spark, sf):
    return table(spark, sf, "customer").where(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey").join(table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(f"SELECT cache_key, analysis FROM {CACHE} WHERE expires_at >= TIMESTAMP '{NOW}'")
def st12_ttl_delete(spark, sf):
    return B.delete_expired(_cache(spark, sf), _now()).select("cache_key", "analysis")


@query(f"SELECT user_id, max(event_id) AS last_event FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS")
def st13_stale_windows(spark, sf):
    windows = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("window_start"), F.max("event_id").alias("last_event"))
    return B.delete_stale(windows, _now()).select("user_id", "last_event")


@query(f"""SELECT id, user_id, overall_score FROM ({ENTRIES}) WHERE id % 4 = 0 UNION ALL
 SELECT id, user_id, CAST(overall_score + CASE WHEN id % 4 = 1 THEN 1000 ELSE 2000 END AS INTEGER) FROM ({ENTRIES}) e WHERE user_id % 5 > 0 AND (id % 4 = 1 OR id % 4 = 2 AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1))""")
def st14_migrate_once(spark, sf):
    every = _entries(spark, sf).select("id", "user_id", "overall_score")
    versioned = lambda df, add: df.withColumn("overall_score", (c("overall_score") + add).cast("int")).withColumn("v", F.lit(1))
    done = every.where("user_id % 5 = 0").select("user_id").distinct()
    return B.migrate_once(every.where("id % 4 = 0"), versioned(every.where("id % 4 = 1"), 1000), versioned(every.where("id % 4 = 2"), 2000), done, "user_id", ["id", "user_id"], "v")


@query(f"""WITH e AS ({ENTRIES}), runs AS (SELECT id, user_id, CAST(overall_score + CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 3000 END AS INTEGER) AS overall_score, id % 4 AS part FROM e)
 SELECT id, user_id, overall_score, user_id % 2 = 0 AS in_first FROM e WHERE id % 4 = 0
 UNION ALL SELECT id, user_id, overall_score, user_id % 2 = 0 FROM runs WHERE part = 1 AND user_id % 7 <> 3
 UNION ALL SELECT id, user_id, overall_score, user_id % 2 = 0 FROM runs WHERE part = 2 AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 1)""")
def st14_migrate_marked(spark, sf):
    """Two runs: the first migrates half of the users, the second comes with other rows for all and finds the first's markers.

    Users whose number leaves 3 by 7 have a legacy list that is empty, so neither it nor their current rows are taken.
    """
    root = shared_path(spark, "migration")
    every = _entries(spark, sf).select("id", "user_id", "overall_score")
    present = every.where("id % 4 = 1").select("user_id").distinct()
    versioned = lambda df, add: df.withColumn("overall_score", (c("overall_score") + add).cast("int")).withColumn("v", F.lit(1))

    def run(owners, add):
        legacy, current = versioned(every.where("id % 4 = 1 and user_id % 7 <> 3"), add), versioned(every.where("id % 4 = 2"), add)
        return B.migrate(root, every.where("id % 4 = 0"), legacy, current, owners, "user_id", ["id", "user_id"], "v", present)

    run(every.where("user_id % 2 = 0"), 1000)
    table = run(every, 3000)
    first = B.migrated_table(spark, root)[1].select("user_id", (c("version") == 1).alias("in_first"))
    return table.join(first, "user_id").select("id", "user_id", "overall_score", "in_first")
