"""Confidence, penalty and label expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rowassay import constants as C


def banded(value: Column, bands, otherwise: str) -> Column:
    """Label of the first band whose lower bound the value reaches (bands listed highest first)."""
    first, *rest = bands
    chain = F.when(value >= F.lit(first[0]), F.lit(first[1]))
    for bound, label in rest:
        chain = chain.when(value >= F.lit(bound), F.lit(label))
    return chain.when(value.isNotNull(), F.lit(otherwise))


def mapped(key: Column, table: dict, default) -> Column:
    """A small fixed lookup as a CASE expression."""
    items = list(table.items())
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), items[1:], F.when(key == items[0][0], F.lit(items[0][1])))
    return chain.otherwise(F.lit(default))


def clamp01(value: Column) -> Column:
    """Value limited to [0, 1]; NULL stays NULL."""
    return F.when(value < 0.0, F.lit(0.0)).when(value > 1.0, F.lit(1.0)).otherwise(value.cast("double"))


def detection_confidence(value: Column, threshold: Column) -> Column:
    """How far a measurement lies above its threshold, as a share of the threshold."""
    limit = F.greatest(threshold.cast("double"), F.lit(C.CONFIDENCE_EPSILON))
    return clamp01((value - limit) / limit)


def data_error_confidence(kind: Column, value: Column) -> Column:
    """Chance that a finding of this kind and size is an actual error."""
    chain = None
    for name, (base, slope, scale) in C.ERROR_CONFIDENCE.items():
        share = value if name == C.MISSINGNESS else clamp01(value / F.lit(scale))
        level = clamp01(F.lit(base) + F.lit(slope) * share)
        chain = F.when(kind == name, level) if chain is None else chain.when(kind == name, level)
    return chain.otherwise(F.lit(C.UNKNOWN_KIND_CONFIDENCE))


def penalty_weight(severity: Column) -> Column:
    return mapped(severity, C.SEVERITY_PENALTY_WEIGHT, 0.0)


def penalty(kind: Column, severity: Column, value: Column, threshold: Column) -> Column:
    """Severity weight times both confidences."""
    return penalty_weight(severity) * detection_confidence(value, threshold) * data_error_confidence(kind, value)


def grade(score: Column) -> Column:
    return banded(score, C.GRADE_BANDS, C.LOWEST_GRADE)


def health_word(score: Column) -> Column:
    return banded(score, C.HEALTH_BANDS, C.LOWEST_HEALTH)


def severity_rank(severity: Column) -> Column:
    """5 for critical down to 1 for info; 0 for anything else, NULL included."""
    return mapped(F.lower(severity), C.SEVERITY_RANK, 0)


def impact_label(severity: Column) -> Column:
    word = F.lower(severity)
    return (
        F.when(word.isin("critical", "high"), "High")
        .when(word == "medium", "Medium")
        .when(word.isin("low", "info"), "Low")
        .otherwise("unknown")
    )


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").otherwise("Low")


def age_label(moment: Column, now: Column) -> Column:
    """Rough age of a moment: minutes, hours, days, then months of 30 days; NULL is unknown."""
    minutes = F.floor(F.timestamp_diff("SECOND", moment.cast("timestamp"), now.cast("timestamp")) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(moment.isNull(), "unknown")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )
