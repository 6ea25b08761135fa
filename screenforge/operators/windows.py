"""Rank and running operators over short, already aggregated series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max_composite(df: DataFrame, key: str, metrics: Sequence[str], alias: str = "composite") -> DataFrame:
    """Each metric scaled to [0, 1] over all rows (constant metrics 0), and their mean."""
    ends = df.agg(*[x for m in metrics for x in (F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))])
    e = df.withColumn("__e", ends.select(F.struct(*ends.columns)).scalar())
    scaled = {
        f"{m}_scaled": F.coalesce(F.try_divide(F.col(m) - F.col(f"__e.lo_{m}"), F.col(f"__e.hi_{m}") - F.col(f"__e.lo_{m}")), F.lit(0.0))
        for m in metrics
    }
    out = e.withColumns(scaled).drop("__e")
    total: Column = sum((F.col(c) for c in scaled), F.lit(0.0))
    return out.withColumn(alias, total / len(metrics)).select(key, *metrics, *scaled, alias)


def components_to_reach(variance: DataFrame, keys: Sequence[str], index: str, share: str, threshold: float) -> DataFrame:
    """Smallest component count whose cumulative share reaches the threshold, all of them if none does."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    c = variance.withColumn("__cum", F.sum(share).over(w))
    first = F.min(F.when(F.col("__cum") >= threshold - 1e-12, F.col(index)))
    return c.groupBy(*keys).agg(F.coalesce(first, F.max(index)).alias("n_components"))


def normalise_rows(df: DataFrame, keys: Sequence[str], value: str, alias: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(alias, F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)))


def normalise_to_first(df: DataFrame, keys: Sequence[str], order: str, value: str, alias: str = "normalised") -> DataFrame:
    """Divide by the value at the smallest order key where that is above 1e-9."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(alias, F.when(first > 1e-9, F.col(value) / F.nullif(first, F.lit(0.0))).otherwise(F.col(value)))


def step_delta(df: DataFrame, keys: Sequence[str], step: str, value: str, alias: str = "delta") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(step)
    return df.withColumn(alias, F.col(value) - F.lag(value).over(w))


def normalise_to_baseline(df: DataFrame, keys: Sequence[str], name: str, baseline: str, value: str, zero: float | None = None, alias: str = "normalised") -> DataFrame:
    """Divide by the baseline row of the same key; a zero baseline gives null, or counts as ``zero``."""
    base = df.where(F.col(name) == baseline).groupBy(*keys).agg(F.max(value).alias("__b"))
    b = F.col("__b") if zero is None else F.when(F.col("__b") == 0, F.lit(zero)).otherwise(F.col("__b"))
    return df.join(base, list(keys), "left").withColumn(alias, F.try_divide(F.col(value), b)).drop("__b")
