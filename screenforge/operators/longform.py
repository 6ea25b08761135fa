"""Long, array and wide shapes of a feature table.

Per-feature statistics run on the long shape: the plan keeps one size whatever the number of
features, and every (group, feature) pair is its own shuffle key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.functions.scalars import METADATA_PATTERNS, finite


def feature_columns(df: DataFrame, patterns: Sequence[str] = METADATA_PATTERNS) -> list[str]:
    """Numeric columns whose name contains none of the metadata patterns."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and not any(p in f.name for p in patterns)
    ]


def feature_columns_by_prefix(
    df: DataFrame, organelles: Sequence[str], metadata: Sequence[str] = ()
) -> list[str]:
    starts = ("cell_", "cp_cell_", "network_", *(f"{o}_" for o in organelles))
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in metadata and f.name.startswith(starts)
    ]


def level_feature_columns(df: DataFrame, metadata: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in metadata and not f.name.endswith("_count")
    ]


def to_long(df: DataFrame, ids: Sequence[str | Column], features: Sequence[str], missing: str = "skip") -> DataFrame:
    """(ids…, feature, value); NaN and infinities are null, or 0 with ``missing='zero'``."""
    def clean(name: str) -> Column:
        v = finite(F.col(name))
        return (F.coalesce(v, F.lit(0.0)) if missing == "zero" else v).alias(name)

    shaped = df.select(*ids, *[clean(f) for f in features])
    keep = [c for c in shaped.columns if c not in set(features)]
    return shaped.unpivot(keep, list(features), "feature", "value")


def array_to_long(df: DataFrame, ids: Sequence[str], vec: str, name: str = "dim") -> DataFrame:
    """(ids…, dim, value) from an array column; dims count from 0."""
    out = df.select(*ids, F.posexplode(vec).alias(name, "value"))
    return out.withColumn("value", finite(F.col("value")))


def to_wide(long: DataFrame, ids: Sequence[str], names: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Back to one column per feature; the list of names is explicit, so no extra pass finds it."""
    return long.groupBy(*ids).pivot(feature, list(names)).agg(F.first(value))


def to_vector(long: DataFrame, ids: Sequence[str], order: str = "feature", value: str = "value") -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return long.groupBy(*ids).agg(F.transform(pairs, lambda p: p[value]).alias("features"))
