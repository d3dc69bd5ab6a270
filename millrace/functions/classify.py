"""Numeric and string values to labels; all plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_tier(score: Column) -> Column:
    """A missing score counts as 0."""
    return (
        F.when(score >= 85, "EXCELLENT")
        .when(score >= 70, "GOOD")
        .when(score >= 50, "AVERAGE")
        .when(score >= 30, "BELOW AVERAGE")
        .otherwise("POOR")
    )


def review_accent(score: Column, out_of: Column) -> Column:
    return F.when(score >= out_of, "excellent").when(score >= out_of * 0.8, "decent").when(score >= out_of * 0.6, "fair").otherwise("concerning")


def stars(score: Column, out_of: int = 5) -> Column:
    """Fill of each star: 1, 0.5 or 0; a fraction of 0.3 or more is half a star."""
    full = F.floor(score)
    half = score - full >= 0.3
    return F.transform(
        F.sequence(F.lit(0), F.lit(out_of - 1)), lambda i: F.when(i < full, 1.0).when((i == full) & half, 0.5).otherwise(0.0)
    )


def nutriscore_color(grade: Column) -> Column:
    """Null (hidden) without a grade; grey for unknown letters."""
    letter = F.lower(grade)
    known = F.when(letter == "a", "#1B8C3A").when(letter == "b", "#85BB2F").when(letter == "c", "#FECB02").when(letter == "d", "#EE8100").when(letter == "e", "#E63E11")
    return F.when(grade != "", F.coalesce(known, F.lit("gray")))


def nova_color(group: Column) -> Column:
    named = F.when(group == 1, "excellent").when(group == 2, "good").when(group == 3, "decent").when(group == 4, "bad").otherwise("secondary")
    return F.when(group != 0, named)


def source_label(source: Column) -> Column:
    named = F.when(source == "verified", "Verified Data").when(source == "enriched", "AI + Verified").when(source == "cached", "Instant Result")
    return named.otherwise("AI Estimated")


def safety_label(level: Column) -> Column:
    return F.when(level == "safe", "SAFE").when(level == "caution", "CAUTION").when(level == "dangerous", "DANGEROUS").otherwise("UNKNOWN")


def safety_color(level: Column) -> Column:
    """Anything unknown takes the colour of danger."""
    return F.when(level == "safe", "excellent").when(level == "caution", "decent").otherwise("concerning")


def pet_label(pet: Column) -> Column:
    return F.when(pet == "dog", "dogs").otherwise("cats")


def age_label(level: Column) -> Column:
    return F.when(level == "safe", "Safe").when(level == "caution", "Caution").otherwise("Avoid")


def rating_dot(rating: Column) -> Column:
    return F.when(rating.isin("good", "neutral", "bad"), rating).otherwise("neutral")


def quality_label(rating: Column) -> Column:
    return F.when(rating == "good", "Good ingredient").when(rating == "bad", "Concerning ingredient").otherwise("Neutral ingredient")


def can_scan(pro: Column, count: Column, limit: int = 3) -> Column:
    return pro | (count < limit)


def remaining_scans(pro: Column, count: Column, limit: int = 3) -> Column:
    """Null where unlimited."""
    return F.when(~pro, F.greatest(F.lit(0), limit - count))


def ring_offset(score: Column, radius: float) -> Column:
    """Unfilled length of a score ring."""
    return 2 * math.pi * radius * (1 - score / 100)


def level_dot(level: Column) -> Column:
    known = F.when(F.lower(level) == "high", "good").when(F.lower(level) == "moderate", "neutral").when(F.lower(level) == "low", "decent")
    return F.when(level != "", F.coalesce(known, F.lit("neutral")))
