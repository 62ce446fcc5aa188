"""Numbers: clamps, logarithmic norms, engagement, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ENGAGEMENT = {"likes": 1.0, "replies": 2.0, "reposts": 3.0, "comments": 1.5, "stars": 2.0}


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def log_norm(x: Column, ceiling: float) -> Column:
    return clamp01(F.log1p(F.greatest(x, F.lit(0.0))) / F.log1p(F.lit(float(ceiling))))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def engagement(columns: list[str]) -> Column:
    """Weighted sum of the metrics that are there; likes and the like, half a score, twice a gain."""
    total = F.lit(0.0)
    for name, weight in ENGAGEMENT.items():
        if name in columns:
            total = total + F.coalesce(F.col(name), F.lit(0)) * weight
    if "score" in columns:
        total = total + F.coalesce(F.col("score"), F.lit(0)) * 0.5
    if "delta" in columns:
        total = total + F.greatest(F.coalesce(F.col("delta"), F.lit(0)), F.lit(0)) * 2.0
    return total


def engagement_key(columns: list[str]) -> Column:
    return engagement([c for c in columns if c in ENGAGEMENT])


def age_label(seconds: Column) -> Column:
    """(value, unit): seconds below 90, minutes below 120, then hours."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 90, F.struct(seconds.cast("long").alias("value"), F.lit("s").alias("unit"))).when(minutes < 120, F.struct(minutes.cast("long").alias("value"), F.lit("min").alias("unit"))).otherwise(F.struct(F.floor(seconds / 3600).cast("long").alias("value"), F.lit("h").alias("unit")))


def sparkline_tone(series: Column) -> Column:
    """hot from 1.6 times the mean on, warm from the mean on, else cool; all flat if nothing exceeds 1."""
    mean = F.aggregate(series, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(series), F.lit(1))
    return F.transform(series, lambda x: F.when(F.array_max(series) <= 1, "flat").when(x >= mean * 1.6, "hot").when(x >= mean, "warm").otherwise("cool"))
