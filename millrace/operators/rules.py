"""Scoring rules that exist only as prose in the specification; not parity, and labelled so.

Choices made here: the weighted mean is taken first; category caps and floors before it, overall caps after it; a cap
wins over a floor; "multiple" means two or more; ingredient names match as lower-case substrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category weights.
WEIGHTS = {"protein": 0.25, "safety": 0.20, "nutrition": 0.20, "filler": 0.20, "additives": 0.15}
#: Vocabularies.
BY_PRODUCTS = ("by-product", "byproduct")
MEALS = ("chicken meal", "beef meal", "lamb meal", "fish meal", "turkey meal", "meat meal")
MEATS = ("chicken", "beef", "lamb", "salmon", "turkey", "duck", "fish", "venison")
TOXIC_PRESERVATIVES = ("bha", "bht", "ethoxyquin")
FILLERS = ("corn", "wheat", "soy")
UNNAMED_GRAINS = ("grain", "cereal")
LEGUMES = ("pea", "lentil", "chickpea", "potato", "bean")
COLORS = ("red 40", "yellow 5", "blue 2")
NATURAL = ("mixed tocopherols", "rosemary")
GOOD = ("probiotic", "omega", "chelated", *MEATS)
BAD = (*TOXIC_PRESERVATIVES, *BY_PRODUCTS, "sugar", "propylene glycol", "menadione", *COLORS)
NEUTRAL = ("rice", "barley", "oat")
#: Species, food, and the part or amount that it holds for.
TOXIC_FOODS = (
    ("dog", "grapes", None), ("dog", "raisins", None), ("dog", "chocolate", None), ("dog", "xylitol", "birch sugar too"), ("dog", "onions", None), ("dog", "garlic", "large amounts"), ("dog", "macadamia nuts", None),
    ("dog", "alcohol", None), ("dog", "caffeine", None), ("dog", "avocado", "pit or skin"), ("dog", "yeast dough", "raw"), ("dog", "nutmeg", None), ("cat", "onions", None), ("cat", "garlic", None), ("cat", "chocolate", None),
    ("cat", "caffeine", None), ("cat", "alcohol", None), ("cat", "grapes", None), ("cat", "raisins", None), ("cat", "xylitol", None), ("cat", "eggs", "raw"), ("cat", "lilies", None),
)


def _any(ingredients: Column, words: tuple[str, ...]) -> Column:
    return F.exists(ingredients, lambda x: _has(x, words))


def _has(name: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.lower(name).contains(w)
    return found


def _count(ingredients: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(ingredients, lambda x: _has(x, words)))


def weighted_overall(scores: dict[str, Column]) -> Column:
    total = sum(WEIGHTS.values())
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = out + scores[k] * (w / total)
    return out


def mean_consistent(overall: Column, scores: dict[str, Column], slack: float = 15.0) -> Column:
    """An overall score not that far above the categories' plain mean (mean 55 forbids 70)."""
    mean = sum(scores.values(), F.lit(0.0)) / len(scores)
    return overall - mean < slack


def protein(score: Column, ingredients: Column) -> Column:
    first = F.lower(ingredients[0])
    whole = _has(first, MEATS) & ~_has(first, MEALS) & ~_has(first, BY_PRODUCTS)
    out = F.when(whole, F.greatest(score, F.lit(70))).when(_has(first, MEALS), F.least(F.greatest(score, F.lit(50)), F.lit(69))).otherwise(score)
    out = F.when(_any(ingredients, BY_PRODUCTS), F.least(out, F.lit(50))).otherwise(out)
    return F.when(~_any(ingredients, MEATS), F.least(out, F.lit(30))).otherwise(out)


def safety(score: Column, ingredients: Column) -> Column:
    return F.when(_any(ingredients, ("menadione",)), F.greatest(score - 15, F.lit(0))).otherwise(score)


def filler(score: Column, ingredients: Column, grain_free: Column) -> Column:
    out = F.when(_any(F.slice(ingredients, 1, 3), FILLERS), F.least(score, F.lit(40))).otherwise(score)
    out = F.when(_count(ingredients, UNNAMED_GRAINS) >= 2, F.least(out, F.lit(30))).otherwise(out)
    return F.when(grain_free & (_count(ingredients, LEGUMES) >= 2), F.least(out, F.lit(55))).otherwise(out)


def additives(score: Column, ingredients: Column) -> Column:
    out = F.when(_any(ingredients, NATURAL), F.greatest(score, F.lit(80))).otherwise(score)
    out = F.when(_any(ingredients, ("artificial flavor",)), F.least(out, F.lit(40))).otherwise(out)
    return F.when(_any(ingredients, COLORS), F.least(out, F.lit(30))).otherwise(out)


def capped_overall(overall: Column, ingredients: Column) -> Column:
    out = F.when(_any(ingredients, TOXIC_PRESERVATIVES), F.least(overall, F.lit(35.0))).otherwise(overall)
    out = F.when(_any(ingredients, ("propylene glycol",)), F.least(out, F.lit(40.0))).otherwise(out)
    return F.when(_has(ingredients[0], BY_PRODUCTS), F.least(out, F.lit(50.0))).otherwise(out)


def score_product(products: DataFrame, ingredients: str = "ingredients", grain_free: str = "grain_free") -> DataFrame:
    """Category scores after their rules, the weighted overall score, and that after its caps."""
    x = F.col(ingredients)
    adjusted = {
        "protein": protein(F.col("protein"), x),
        "safety": safety(F.col("safety"), x),
        "nutrition": F.col("nutrition"),
        "filler": filler(F.col("filler"), x, F.col(grain_free)),
        "additives": additives(F.col("additives"), x),
    }
    out = products.withColumns(adjusted)
    overall = F.round(weighted_overall({k: F.col(k) for k in WEIGHTS}), 4)
    return out.withColumn("weighted", overall).withColumn("overall", capped_overall(F.col("weighted"), x))


def toxic_foods(spark) -> DataFrame:
    """The fixed dimension of toxic foods, 22 rows."""
    return spark.createDataFrame(list(TOXIC_FOODS), "species string, food string, note string")


def rate_ingredient(name: Column) -> Column:
    return F.when(_has(name, BAD), "bad").when(_has(name, GOOD), "good").when(_has(name, NEUTRAL), "neutral")
