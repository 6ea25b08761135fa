"""Summaries of cell, guide and gene tables: quality, consistency, coverage and per-group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.scalars import strip_aggregates
from screenforge.operators.skew import quantiles, top_n


def variance_ranking(long: DataFrame, n: int | None = None, value: str = "value") -> DataFrame:
    out = long.groupBy("feature").agg(F.var_samp(value).alias("variance"))
    ordered = out.orderBy(F.col("variance").desc_nulls_last(), "feature")
    return ordered.limit(n) if n else ordered


def low_variance_threshold(variances: DataFrame, floor: float = 1e-8, keys: Sequence[str] = ()) -> DataFrame:
    """max(5th percentile of the variances, floor) per group; one row per feature comes in."""
    q = F.greatest(F.percentile("variance", 0.05), F.lit(floor)).alias("threshold")
    return variances.groupBy(*keys).agg(q)


def high_variance_features(long: DataFrame, fixed: float | None = None) -> DataFrame:
    """(feature, variance) of features that stay: variance at least the threshold."""
    variances = long.groupBy("feature").agg(F.var_samp("value").alias("variance"))
    if fixed is not None:
        return variances.where(F.col("variance") >= fixed)
    cut = low_variance_threshold(variances).select("threshold").scalar()
    return variances.where(F.col("variance") >= cut)


def group_quality(long: DataFrame, organelle: str = "organelle") -> DataFrame:
    """Per organelle: variance summary, share of flat and of empty features, and a status."""
    per = long.groupBy(organelle, "feature").agg(
        F.var_samp("value").alias("variance"),
        (F.avg((F.col("value").isNull() | (F.col("value") == 0)).cast("double")) * 100).alias("empty"),
    )
    cut = low_variance_threshold(per, keys=[organelle])
    out = per.join(cut, organelle).groupBy(organelle).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg("variance").alias("mean_variance"),
        F.median("variance").alias("median_variance"),
        (F.avg((F.col("variance") < F.col("threshold")).cast("double")) * 100).alias("pct_low_variance"),
        F.avg("empty").alias("pct_zero_or_null"),
    )
    status = (
        F.when(F.col("pct_low_variance") > 80, "POOR").when(F.col("pct_low_variance") > 50, "MARGINAL")
        .when(F.col("pct_zero_or_null") > 80, "SPARSE").otherwise("GOOD")
    )
    return out.withColumn("status", status)


def within_gene_consistency(long_guides: DataFrame, gene: str = "gene", threshold: float = 1.0) -> DataFrame:
    """Mean over features of std / (mean + 1e-10) for genes with two guides or more."""
    per = long_guides.groupBy(gene, "feature").agg(
        F.count(F.lit(1)).alias("n"), (F.stddev_samp("value") / (F.avg("value") + F.lit(1e-10))).alias("cv")
    )
    out = per.groupBy(gene).agg(F.max("n").alias("n_guides"), F.avg("cv").alias("mean_cv"))
    return out.where(F.col("n_guides") >= 2).withColumn("inconsistent", F.col("mean_cv") > threshold)


def group_size_summary(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).count()
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("count").alias("mean_rows"), F.stddev_samp("count").alias("std_rows")
    )


def duplicate_diagnosis(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """One row per feature group: repeated rows, distinct values, zeros, constants and range.

    Repeats are counted by a distinct over the columns, which combines before the shuffle, so a
    hot duplicate moves one row per task.
    """
    parts = None
    for name, cols in groups.items():
        per_col = df.select(*cols).unpivot([], list(cols), "column", "v")
        stats = per_col.groupBy("column").agg(
            F.count_distinct("v").alias("d"), F.sum((F.col("v") == 0).cast("long")).alias("z"),
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"),
        ).agg(
            F.avg("d").alias("avg_distinct"), F.min("d").alias("min_distinct"), F.max("d").alias("max_distinct"),
            F.sum((F.col("d") <= 1).cast("long")).alias("n_constant"),
            (F.sum("z") / F.sum("n") * 100).alias("zero_pct"), (F.max("hi") - F.min("lo")).alias("value_range"),
            F.max("n").alias("n_rows"),
        )
        unique = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n_unique"))
        one = stats.withColumn("g", F.lit(name)).join(unique.withColumn("g", F.lit(name)), "g").select(
            F.col("g").alias("organelle"), "n_rows", "n_unique",
            ((F.col("n_rows") - F.col("n_unique")) / F.col("n_rows") * 100).alias("duplicate_pct"),
            "avg_distinct", "min_distinct", "max_distinct", "zero_pct", "n_constant", "value_range",
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def effect_summary(effects: DataFrame, organelle: str = "organelle", d: str = "d", keys: Sequence[str] = ()) -> DataFrame:
    """Per organelle, within ``keys``: largest |d|, number of features, mean d and the feature with the largest |d|."""
    return effects.groupBy(*keys, organelle).agg(
        F.max(F.abs(d)).alias("max_abs_d"), F.count(F.lit(1)).alias("n_features"), F.avg(d).alias("mean_d"),
        F.max_by("feature", F.struct(F.abs(d), "feature")).alias("top_feature"),
    )


def cluster_profiles(long: DataFrame, cluster: str = "cluster", n_features: int = 100, n_ends: int = 20) -> DataFrame:
    """Mean per cluster of the features that vary most between clusters, z-scored over clusters."""
    means = long.groupBy(cluster, "feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    means = means.where(F.col("n") >= 2)
    spread = means.groupBy("feature").agg(
        F.var_samp("mean").alias("between"), F.avg("mean").alias("mu"), F.stddev_pop("mean").alias("sd")
    )
    keep = spread.orderBy(F.col("between").desc_nulls_last(), "feature").limit(n_features)
    z = means.join(keep, "feature").select(
        cluster, "feature", "mean", F.coalesce(F.try_divide(F.col("mean") - F.col("mu"), F.col("sd")), F.lit(0.0)).alias("z")
    )
    up = Window.partitionBy(cluster).orderBy(F.col("z").desc(), "feature")
    down = Window.partitionBy(cluster).orderBy(F.col("z").asc(), "feature")
    ranked = z.withColumn("top_rank", F.row_number().over(up)).withColumn("bottom_rank", F.row_number().over(down))
    return ranked.where((F.col("top_rank") <= n_ends) | (F.col("bottom_rank") <= n_ends))


def grouped_by_base_metric(effects: DataFrame, n: int | None = None) -> DataFrame:
    """Features of one base metric merge when all effects share a sign, else each stays alone.

    Suffix stripping covers mean, std, median, max and min at every level.
    """
    base = F.regexp_replace("feature", r"(_(mean|std|median|max|min))+$", "")
    e = effects.withColumn("base_metric", base)
    signs = e.groupBy("base_metric").agg((F.bool_and(F.col("d") > 0) | F.bool_and(F.col("d") < 0)).alias("same"))
    keyed = e.join(signs, "base_metric").withColumn(
        "display", F.when(F.col("same"), F.col("base_metric")).otherwise(F.col("feature"))
    )
    out = keyed.groupBy("base_metric", "display").agg(
        F.avg("d").alias("mean_d"), F.max(F.abs("d")).alias("max_abs_d"), F.count(F.lit(1)).alias("n_features"),
        F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("features"),
    )
    return out.orderBy(F.col("max_abs_d").desc(), "display").limit(n) if n else out


def supercategory_scores(scores: DataFrame, membership: DataFrame, category: str = "category") -> DataFrame:
    """Cluster scores to categories: mean mAP, mean p, any significant."""
    return scores.join(membership, "cluster").groupBy(category).agg(
        F.avg("mean_average_precision").alias("mean_map"), F.avg("p_value").alias("mean_p"),
        F.bool_or("significant").alias("any_significant"), F.count(F.lit(1)).alias("n_clusters"),
    )


def category_coverage(assigned: DataFrame, genes: DataFrame, gene: str = "gene", category: str = "category") -> DataFrame:
    """Genes per category and the share of all genes each holds."""
    total = genes.select(F.count_distinct(gene).alias("t")).scalar()
    return assigned.groupBy(category).agg(F.count_distinct(gene).alias("n_genes")).withColumn(
        "share", F.col("n_genes") / total
    )


def categories_per_gene(assigned: DataFrame, gene: str = "gene", category: str = "category") -> DataFrame:
    per = assigned.groupBy(gene).agg(F.count_distinct(category).alias("c"))
    return per.agg(F.avg("c").alias("mean_categories"), F.max("c").alias("max_categories"), F.count(F.lit(1)).alias("n_genes"))


def reporter_stats(reports: DataFrame) -> DataFrame:
    """Cells and sorted experiments per signal with a display label such as ``x (1,234 cells)``."""
    one = reports.withColumn("e", F.explode(F.split("experiment", ",")))
    exps = one.groupBy("signal").agg(F.array_join(F.sort_array(F.collect_set(F.trim("e"))), ",").alias("experiments"))
    total = reports.groupBy("signal").agg(F.sum("n_cells").alias("n_cells"))
    label = F.concat(F.col("signal"), F.lit(" ("), F.format_number("n_cells", 0), F.lit(" cells)"))
    return total.join(exps, "signal").withColumn("display", label)


def gene_area_variance(cells: DataFrame, gene: str, guide: str, area: str, n: int = 5) -> DataFrame:
    """Guides of the ``n`` genes whose cell area varies most, with the variance per guide."""
    top = cells.groupBy(gene).agg(F.var_samp(area).alias("gene_variance"))
    top = top.orderBy(F.col("gene_variance").desc_nulls_last(), gene).limit(n)
    per_guide = cells.groupBy(gene, guide).agg(F.var_samp(area).alias("guide_variance"), F.count(F.lit(1)).alias("n_cells"))
    return per_guide.join(top, gene)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Density histogram per group on a common range; the last bin includes the maximum."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.struct("lo", "hi").alias("r"))
    r = F.col("__r")
    width = (r["hi"] - r["lo"]) / bins
    binned = df.where(F.col(value).isNotNull()).withColumn("__r", ends.scalar()).withColumn(
        "bin", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(value) - r["lo"], width)), F.lit(0))).cast("int")
    )
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first(width).alias("w"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "bin", "n", F.try_divide(F.col("n"), total * F.col("w")).alias("density"))


def metric_comparison(long: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Distribution (quantile array) of the value per (metric, organelle, group)."""
    return quantiles(long, keys, "value", probs, "quantiles")


def extreme_genes(long: DataFrame, gene: str = "gene", min_rows: int = 3, n: int = 5) -> DataFrame:
    """Per feature: the ``n`` genes with the highest and the lowest mean among genes with enough rows."""
    g = long.groupBy("feature", gene).agg(F.avg("value").alias("mean"), F.count("value").alias("n_rows"))
    g = g.where(F.col("n_rows") >= min_rows)
    hi = top_n(g, ["feature"], [F.col("mean").desc(), F.col(gene)], n).withColumn("side", F.lit("high"))
    lo = top_n(g, ["feature"], [F.col("mean").asc(), F.col(gene)], n).withColumn("side", F.lit("low"))
    return hi.unionByName(lo)


def centroids(df: DataFrame, cluster: str, x: str, y: str, noise: str | None = None) -> DataFrame:
    rows = df if noise is None else df.where(F.col(cluster) != noise)
    return rows.groupBy(cluster).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n"))


def prefixed_metrics(parts: dict[str, DataFrame], level: str) -> DataFrame:
    """Upstream (metric, value) tables under one roof: level, stage, ``<prefix>_<metric>``, value."""
    out = None
    for prefix, df in parts.items():
        one = df.select(
            F.lit(level).alias("level"), F.lit(prefix).alias("stage"),
            F.concat_ws("_", F.lit(prefix), "metric").alias("metric"), F.col("value").cast("double").alias("value"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def timing_summary(timings: DataFrame, columns: Sequence[str]) -> DataFrame:
    return timings.select(*columns).unpivot([], list(columns), "task", "seconds").groupBy("task").agg(
        F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("slowest")
    )


def strip_suffix(df: DataFrame, column: str = "feature") -> DataFrame:
    return df.withColumn("base", strip_aggregates(F.col(column), recursive=True))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def flag_low_counts(guides: DataFrame, threshold: int) -> DataFrame:
    low: Column = F.col("n_cells") < threshold
    return guides.agg(
        F.count(F.lit(1)).alias("n_guides"), F.sum(low.cast("long")).alias("n_low"),
        (F.avg(low.cast("double")) * 100).alias("pct_low"),
    )
