"""Level tables: object -> cell -> guide -> gene, each the seven statistics of a lower level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.functions.scalars import AGGREGATES, finite, has_guide
from screenforge.operators.longform import to_long
from screenforge.operators.skew import join_keys, largest_group, quantiles
from screenforge.session import group_limit

WIDE_FEATURE_LIMIT = 64


def _stat(name: str, v: Column) -> Column:
    return {
        "sum": F.sum, "mean": F.avg, "median": F.median, "std": F.stddev_samp,
        "min": F.min, "max": F.max, "count": F.count,
    }[name](v)


def seven_stats_long(
    long: DataFrame, keys: Sequence[str], aggs: Sequence[str] = AGGREGATES, approximate: bool = False,
    value: str = "value",
) -> DataFrame:
    """Statistics of ``value`` per group of a long table, one column per statistic.

    All but the median combine before the shuffle. The median is exact: inline while every
    group fits a task, otherwise from bracketed quantiles joined on the keys.
    """
    v = F.col(value)
    others = [_stat(a, v).alias(a) for a in aggs if a != "median"]
    if "median" not in aggs:
        return long.groupBy(*keys).agg(*others)
    if approximate:
        return long.groupBy(*keys).agg(*others, F.percentile_approx(value, 0.5).alias("median"))
    if largest_group(long, keys) <= group_limit(long.sparkSession):
        return long.groupBy(*keys).agg(*others, F.median(value).alias("median"))
    mid = quantiles(long, keys, value, [0.5], "__q").select(*keys, F.col("__q")[0].alias("median"))
    rest = long.groupBy(*keys).agg(*(others or [F.count(F.lit(1)).alias("__rows")]))
    return join_keys(rest, mid, keys, "left").drop("__rows")


def seven_stats(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], aggs: Sequence[str] = AGGREGATES,
    extra: Sequence[Column] = (), prefix: str = "", missing: str = "skip", approximate: bool = False,
) -> DataFrame:
    """Wide statistics ``<prefix><feature>_<agg>`` per group, plus any ``extra`` aggregates.

    Up to ``WIDE_FEATURE_LIMIT`` features one aggregate does it all, without unpivoting. Larger
    feature sets go through the long table, whose plan does not grow with them.
    """
    def cell(name: str) -> Column:
        v = finite(F.col(name))
        return F.coalesce(v, F.lit(0.0)) if missing == "zero" else v

    inline = approximate or "median" not in aggs or largest_group(df, keys) <= group_limit(df.sparkSession)
    if inline and len(features) <= WIDE_FEATURE_LIMIT:
        cols = []
        for f in features:
            for a in aggs:
                c = F.percentile_approx(cell(f), 0.5) if a == "median" and approximate else _stat(a, cell(f))
                cols.append(c.alias(f"{prefix}{f}_{a}"))
        return df.groupBy(*keys).agg(*cols, *extra)
    stats = seven_stats_long(to_long(df, list(keys), features, missing), [*keys, "feature"], aggs, approximate)
    wide = stats.groupBy(*keys).agg(*[
        F.first(F.when(F.col("feature") == f, F.col(a)), ignorenulls=True).alias(f"{prefix}{f}_{a}")
        for f in features for a in aggs
    ])
    if not extra:
        return wide
    return join_keys(df.groupBy(*keys).agg(*extra), wide, keys)


def first_values(columns: Sequence[str], order: str) -> list[Column]:
    """Deterministic first value: the one with the smallest order key."""
    return [F.min_by(c, order).alias(c) for c in columns]


def objects_to_cells(
    objects: DataFrame, features: Sequence[str], cell: str = "cell_id", organelle: str = "organelle",
    aggs: Sequence[str] = AGGREGATES,
) -> DataFrame:
    """One row per (cell, organelle): the statistics of its objects and ``count``, their number."""
    return seven_stats(objects, [cell, organelle], features, aggs, [F.count(F.lit(1)).alias("count")])


def prefixed_by_organelle(
    per_cell: DataFrame, organelles: Sequence[str], cell: str = "cell_id", organelle: str = "organelle", prefix: str = "",
) -> DataFrame:
    """(cell, organelle) rows to one wide row per cell with ``<prefix><organelle>_<column>`` names."""
    values = [c for c in per_cell.columns if c not in (cell, organelle)]
    return per_cell.groupBy(cell).agg(*[
        F.max(F.when(F.col(organelle) == o, F.col(v))).alias(f"{prefix}{o}_{v}") for o in organelles for v in values
    ])


def area_fraction(per_cell: DataFrame, cells: DataFrame, area_sum: str, cell_area: str, key: str = "cell_id") -> DataFrame:
    joined = per_cell.join(cells.select(key, cell_area), key)
    return joined.withColumn("area_fraction", F.try_divide(F.col(area_sum), F.col(cell_area)))


def cells_to_guides(
    cells: DataFrame, features: Sequence[str], guide: str = "guide", metadata: Sequence[str] = (), cell: str = "cell_id",
    aggs: Sequence[str] = AGGREGATES, min_cells: int = 1, missing: str = "skip", zero_std: bool = False,
) -> DataFrame:
    """Guide table: statistics, first metadata and ``n_cells``. Cells without a valid guide leave first."""
    valid = cells.where(has_guide(F.col(guide).cast("string")))
    extra = [*first_values(metadata, cell), F.count(F.lit(1)).alias("n_cells")]
    out = seven_stats(valid, [guide], features, aggs, extra, missing=missing)
    if min_cells > 1:
        out = out.where(F.col("n_cells") >= min_cells)
    if zero_std:
        out = out.fillna(0.0, [f"{f}_std" for f in features if "std" in aggs])
    return out


def cells_to_genes(
    cells: DataFrame, features: Sequence[str], gene: str = "gene", guide: str = "guide", metadata: Sequence[str] = (),
    cell: str = "cell_id", aggs: Sequence[str] = AGGREGATES, missing: str = "skip",
) -> DataFrame:
    """Gene table from cells, not from guides, so medians are those of the cells."""
    extra = [
        *first_values(metadata, cell), F.count(F.lit(1)).alias("n_cells"), F.count_distinct(guide).alias("n_guides"),
    ]
    return seven_stats(cells.where(F.col(gene).isNotNull()), [gene], features, aggs, extra, missing=missing)
