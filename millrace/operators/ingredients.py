"""Ingredient lists, nutrition grids and documents: counts, shares, visible prefixes, field allow-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_placeholder, detect_pet_type, json_error, or_else

#: Fields of a catalog product that may be stored, and their longest text.
ALLOWED_FIELDS = ("productName", "brand", "petType", "barcode", "ingredientsText", "ingredients", "nutriments", "nutriscoreGrade", "novaGroup", "imageUrl")
MAX_FIELD = 10_000


def rating_shares(ratings: Column) -> Column:
    """Counts of good, neutral and bad ratings, the total (unknown ratings included), and segments of those above 0.

    Null for an empty or null list.
    """
    n = F.size(ratings)
    count = lambda r: F.size(F.filter(ratings, lambda x: x == r))
    named = [("good", "Good"), ("neutral", "Neutral"), ("bad", "Concerning")]
    segments = F.array(*[F.when(count(r) > 0, F.struct(F.concat(count(r).cast("string"), F.lit(f" {label}")).alias("label"), (count(r) / n).alias("share"))) for r, label in named])
    out = F.struct(*[count(r).alias(r) for r, _ in named], n.alias("total"), F.filter(segments, lambda s: s.isNotNull()).alias("segments"))
    return F.when(n > 0, out)


def hidden_count(every: Column, visible: Column, total: Column | None = None) -> Column:
    """Rows not shown; ``total`` replaces the list's own size where it is given and not 0."""
    whole = F.size(every) if total is None else F.when(total != 0, total).otherwise(F.size(every))
    return whole - F.size(visible)


def first_n(values: Column, n: int) -> Column:
    """Fixed prefix in natural order."""
    return F.slice(values, 1, n)


def visible_ingredients(values: Column, pro: Column, expanded: Column, free: int = 3, collapsed: int = 5) -> Column:
    """Free users see three; others five until they expand."""
    return F.when(~pro, first_n(values, free)).when(expanded, values).otherwise(first_n(values, collapsed))


def first_match(values: Column, kind: str, identifier: str) -> Column:
    """First element whose ``type`` or ``identifier`` fits; null if none."""
    return F.try_element_at(F.filter(values, lambda p: (p["type"] == kind) | (p["identifier"] == identifier)), F.lit(1))


def visible_toxics(toxics: Column) -> Column:
    return F.when((F.size(toxics) > 0) & (toxics[0] != "None"), toxics)


def visible_benefits(benefits: Column, level: Column) -> Column:
    return F.when((F.size(benefits) > 0) & ~level.eqNullSafe(F.lit("dangerous")), first_n(benefits, 4))


def shows_alternatives(rating: Column, alternatives: Column) -> Column:
    """Any rating but good, a missing one too, with a non-empty list."""
    return ~rating.eqNullSafe(F.lit("good")) & (F.coalesce(F.size(alternatives), F.lit(0)) > 0)


def quick_stats(n: dict[str, Column]) -> Column:
    """Known facts of protein, grain, life stage and calories, in this order, as "label: value"."""
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v)
    return F.filter(
        F.array(
            line("Protein", F.nullif(n["primary_protein"], F.lit(""))),
            line("Grain Free", F.when(n["grain_free"], "Yes").when(~n["grain_free"], "No")),
            line("Life Stage", F.when(~n["life_stage"].isin("", "Unknown"), n["life_stage"])),
            line("Calories", F.when(~n["calories"].isin("", "N/A"), n["calories"])),
        ),
        lambda x: x.isNotNull(),
    )


def nutrition_grid(n: dict[str, Column]) -> Column:
    """Label, value and qualifier of six cells; a qualifier shows only with its percentage, as given."""
    qualified = lambda percent, level: F.when(n[percent] != "", n[level])
    cell = lambda label, value, qualifier=None: F.struct(F.lit(label).alias("label"), value.alias("value"), (F.lit(None).cast("string") if qualifier is None else qualifier).alias("qualifier"))
    return F.array(
        cell("Protein", clean_placeholder(n["protein_percent"]), qualified("protein_percent", "protein_level")),
        cell("Calories", clean_placeholder(n["calories"])),
        cell("Fat", clean_placeholder(n["fat_percent"]), qualified("fat_percent", "fat_level")),
        cell("Life Stage", clean_placeholder(n["life_stage"])),
        cell("Fiber", clean_placeholder(n["fiber_percent"])),
        cell("Grain Free", F.when(n["grain_free"], "Yes").when(~n["grain_free"], "No")),
    )


def sanitize(products: DataFrame) -> DataFrame:
    """Allowed fields only, texts cut to the longest allowed."""
    kinds = dict(products.dtypes)
    return products.select(*[F.substring(c, 1, MAX_FIELD).alias(c) if kinds[c] == "string" else F.col(c) for c in products.columns if c in ALLOWED_FIELDS])


def normalize_product(raw: dict[str, Column]) -> dict[str, Column]:
    """Catalog fields with their fallbacks: texts pass over empty strings, numbers over nulls only.

    The energy fallback may be in another unit; ``energy_unit_known`` says when it was used.
    """
    text = lambda *names: or_else(*[raw[n] for n in names if n in raw], F.lit(""))
    number = lambda *names: F.coalesce(*[raw[n] for n in names if n in raw])
    return {
        "productName": text("product_name", "product_name_en"),
        "brand": text("brands"),
        "petType": detect_pet_type(raw["product_name"], raw["categories"], raw["categories_tags"]),
        "barcode": text("code", "_id"),
        "ingredientsText": text("ingredients_text", "ingredients_text_en"),
        "ingredients": _ingredients(raw.get("ingredients")),
        "protein": number("proteins_100g", "proteins"),
        "fat": number("fat_100g", "fat"),
        "fiber": number("fiber_100g", "crude-fiber_100g", "fiber"),
        "energy": number("energy-kcal_100g", "energy_100g"),
        "energy_unit_known": raw["energy-kcal_100g"].isNotNull(),
        "nutriscoreGrade": F.nullif(or_else(raw["nutriscore_grade"], raw["nutrition_grades"]), F.lit("")),
        "novaGroup": raw["nova_group"],
        "imageUrl": F.nullif(text("image_url", "image_front_url"), F.lit("")),
    }


def _ingredients(raw: Column | None) -> Column:
    """Array of id, text (empty where missing) and percent of array<struct<id,text,percent_estimate>>; empty for null."""
    none = F.array().cast("array<struct<id:string,text:string,percent:double>>")
    if raw is None:
        return none
    item = lambda x: F.struct(
        F.coalesce(x["id"], F.lit("")).alias("id"), F.coalesce(x["text"], F.lit("")).alias("text"), x["percent_estimate"].cast("double").alias("percent")
    )
    return F.coalesce(F.transform(raw, item), none)


def is_valid_analysis(doc: Column) -> Column:
    """A JSON object without an error, with a product name and a numeric overall score from 1 to 100."""
    parsed = F.try_parse_json(doc)
    name = F.try_variant_get(parsed, "$.productName", "string")
    score = F.try_variant_get(parsed, "$.overallScore", "double")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    clean = json_error(parsed).isNull()
    number = ~kind("$.overallScore").isin("STRING", "BOOLEAN", "VOID")
    return F.coalesce(parsed.isNotNull() & clean & (kind("$.productName") == "STRING") & (name != "") & number & score.between(1, 100), F.lit(False))


def request_status(r: dict[str, Column], max_image: int = 7_000_000) -> Column:
    """HTTP status of a request's checks in their order; 200 when all pass."""
    method, auth, body, mode, image, product, pet = (r[k] for k in ("method", "auth", "body_valid", "mode", "image_length", "product_valid", "pet"))
    has_image = F.coalesce(image > 0, F.lit(False))
    large = image > max_image
    ok = F.lit(True)
    return (
        F.when(~(method == "POST"), 405)
        .when(~F.coalesce(F.startswith(auth, F.lit("Bearer ")), F.lit(False)) | (F.length(auth) == 7), 401)
        .when(~body, 400)
        .when(~F.coalesce(mode.isin("photo", "verified", "human_food"), F.lit(False)), 400)
        .when((mode != "verified") & ~has_image, 400)
        .when((mode == "verified") & ~F.coalesce(product, F.lit(False)), 400)
        .when((mode == "human_food") & ~F.coalesce(pet.isin("dog", "cat"), F.lit(False)), 400)
        .when(has_image & large, 413)
        .when(ok, 200)
    )


def start_error(mode: Column, barcode: Column, image: Column, pet: Column) -> Column:
    """Why an analysis cannot start; null when it can."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return (
        F.when((mode == "barcode") & ~given(barcode), "barcode is required")
        .when((mode == "photo") & ~given(image), "image is required")
        .when((mode == "human_food") & ~(given(image) & given(pet)), "image and pet type are required")
    )
