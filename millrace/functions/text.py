"""String functions of the product domain, as column expressions.

White space is the set that JavaScript's ``\\s`` matches, and word edges are ASCII, so results do not depend on the
regex dialect of the engine. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that JavaScript takes for white space, as the inside of a character class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_NOT_WORD_BEFORE, _NOT_WORD_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def or_else(*columns: Column) -> Column:
    """First that is neither null nor the empty string; the last as it is."""
    return F.coalesce(*[F.when(c != "", c) for c in columns[:-1]], columns[-1])


def js_trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+$", "")


#: Lower-case names that are their own key: words with one space between them, and nothing that a key loses.
_OWN_KEY = r"^(?!.*(?:dog food|cat food|formula|recipe))[a-z0-9]++(?: [a-z0-9]++)*+\z"


def normalize_key(name: Column) -> Column:
    """Cache key of a product name; null gives the empty key. Names that are their own key cost one match."""
    low = F.lower(name)
    out = F.regexp_replace(low, r"\(r\)|\(tm\)|\(c\)|®|™|©", "")
    out = F.regexp_replace(out, f"{_NOT_WORD_BEFORE}(dog food|cat food|formula|recipe){_NOT_WORD_AFTER}", "")
    out = F.regexp_replace(out, f"[^a-z0-9{WS}]", "")
    # all white space is single spaces then
    out = F.trim(F.regexp_replace(out, f"[{WS}]+", " "))
    return F.coalesce(F.when(low.rlike(_OWN_KEY), low).otherwise(out), F.lit(""))


def detect_pet_type(name: Column, categories: Column, tags: Column) -> Column:
    """By substring, dog terms first: "delicate" is a cat's."""
    text = F.lower(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(categories, F.lit("")), F.nullif(F.array_join(tags, " "), F.lit(""))))
    dog = text.contains("dog") | text.contains("chien")
    cat = text.contains("cat") | text.contains("chat")
    return F.when(dog, "dog").when(cat, "cat").otherwise("unknown")


def shorten(value: Column) -> Column:
    """Display form of up to 16 characters where possible: no parentheticals, then two words, then one."""
    short = js_trim(F.regexp_replace(value, f"[{WS}]*\\(.*?\\)", ""))
    words = F.split(short, f"[{WS}]+")
    two = F.array_join(F.slice(words, 1, 2), " ")
    cut = F.when(F.length(short) <= 16, short).when(F.size(words) > 2, two).when(F.size(words) == 2, words[0]).otherwise(short)
    return F.when(value.isNull(), "").when(F.length(value) <= 16, value).otherwise(cut)


def truncate_pill(value: Column) -> Column:
    """At most 35 characters, cut at the last space unless it leads."""
    head = F.substring(value, 1, 35)
    whole = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return F.when(F.length(value) <= 35, value).otherwise(F.when(whole != "", whole).otherwise(head))


def two_sentences(verdict: Column, gated: Column) -> Column:
    """The first two sentences where ``gated`` and there are more."""
    return F.when(gated & (F.size(F.split(verdict, r"\. ")) > 2), F.concat(F.substring_index(verdict, ". ", 2), F.lit("."))).otherwise(verdict)


def review_count(n: Column) -> Column:
    """Thousands as K with one decimal unless even; halves round up, in integers."""
    tenths = F.floor((n + 50) / 100).cast("long")
    decimal = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    short = F.when(n % 1000 == 0, F.floor(n / 1000).cast("string")).otherwise(decimal)
    return F.when(n.isNull() | (n == 0), None).when(n >= 1000, F.concat(short, F.lit("K"))).otherwise(n.cast("string"))


def recall_clean(history: Column) -> Column:
    return history.rlike(f"(?i)^(none|no recalls?){_NOT_WORD_AFTER}")


def initials(name: Column) -> Column:
    return F.substring(F.upper(F.array_join(F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1)), "")), 1, 2)


def display_name(full: Column, name: Column, email: Column) -> Column:
    return F.coalesce(full, name, F.split_part(email, F.lit("@"), F.lit(1)))


def slug(name: Column) -> Column:
    clean = F.regexp_replace(name, f"[^a-zA-Z0-9{WS}]", "")
    return F.lower(F.substring(F.regexp_replace(clean, f"[{WS}]+", "-"), 1, 30))


def share_message(name: Column, score: Column, tier: Column, app: str) -> Column:
    return F.concat(name, F.lit(" scored "), score.cast("string"), F.lit("/100 ("), tier, F.lit(f") on {app}!"))


def number_text(n: Column) -> Column:
    """Doubles without a trailing ``.0``."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def verified_text(product: dict[str, Column]) -> Column:
    """The data block of a catalog product: one line per known fact."""
    has = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    per = lambda label, c, unit: F.concat(F.lit(f"{label}: "), number_text(c), F.lit(f"{unit} per 100g"))
    nova = product["nova_group"]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), or_else(product["product_name"], F.lit("Unknown"))),
        has("Brand: ", product["brand"]),
        has("Pet Type: ", product["pet_type"]),
        has("\nIngredients List:\n", product["ingredients_text"]),
        per("Protein", product["protein"], "g"),
        per("Fat", product["fat"], "g"),
        per("Fiber", product["fiber"], "g"),
        per("Energy", product["energy"], " kcal"),
        has("Nutriscore Grade: ", F.upper(product["nutriscore_grade"])),
        F.when(nova != 0, F.concat(F.lit("NOVA Group: "), nova.cast("string"))),
    )


def strip_fence(text: Column) -> Column:
    """A Markdown code fence around a document is taken off."""
    body = js_trim(text)
    inner = F.regexp_replace(F.regexp_replace(body, rf"^```(?:json)?[{WS}]*\n?", ""), rf"\n?```[{WS}]*$", "")
    return F.when(F.startswith(body, F.lit("```")), inner).otherwise(body)


def entry_id(ts_millis: Column) -> Column:
    """Time part of an entry's id, base 36."""
    return F.lower(F.conv(ts_millis.cast("string"), 10, 36))


def error_message(body: Column, status: Column) -> Column:
    """``error`` of a JSON body, the body itself if it is no JSON, or a default with the status."""
    default = F.concat(F.lit("Analysis error ("), status.cast("string"), F.lit(")"))
    parsed = F.try_parse_json(body)
    said = F.when(parsed.isNotNull(), json_error(parsed)).otherwise(F.nullif(body, F.lit("")))
    return F.coalesce(said, default)


def json_error(parsed: Column) -> Column:
    """The ``error`` field of a parsed document as text; null where it is absent, null, false, 0 or the empty string."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.error", "variant"))
    text, number = (F.try_variant_get(parsed, "$.error", t) for t in ("string", "double"))
    none = (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | ((kind == "STRING") & (text == "")) | (~kind.isin("STRING", "BOOLEAN") & (number == 0))
    return F.when(~F.coalesce(none, F.lit(False)), text)


def upstream_status(status: Column) -> Column:
    return F.when(status >= 500, 502).otherwise(status)


def is_session_error(error: Column) -> Column:
    return F.coalesce(error.contains("Session expired") | error.contains("session expired"), F.lit(False))


def error_title(error: Column, mode: Column) -> Column:
    return (
        F.when(is_session_error(error), "Session Expired")
        .when(mode == "history", "Result Expired")
        .when(mode == "barcode", "Barcode Not Found")
        .otherwise("Couldn't analyze this label")
    )


def error_button(error: Column, mode: Column) -> Column:
    return (
        F.when(is_session_error(error), "Sign In Again")
        .when(mode == "history", "Back to Home")
        .when(mode == "barcode", "Take Photo Instead")
        .otherwise("Try Again")
    )


def clean_placeholder(value: Column) -> Column:
    """Null for missing values and their stand-ins."""
    return F.when((value != "") & ~value.isin("N/A", "Unknown"), value)
