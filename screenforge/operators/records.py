"""Record-level work: coverage, deduplication, hit lists, deterministic sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.scalars import bbox_area, has_guide
from screenforge.operators.skew import first_row, top_n, value_ranks

HASH_SPAN = 1 << 60


# --- column housekeeping ----------------------------------------------------------------------
def harmonise_columns(df: DataFrame, renames: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename where the target is absent; where both exist the target keeps its value and fills gaps."""
    for old, new in renames.items():
        if old not in df.columns:
            continue
        if new in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
        else:
            df = df.withColumnRenamed(old, new)
    return df.drop(*drop)


def all_null_columns(df: DataFrame) -> list[str]:
    """Names of columns without a single value, found in one pass."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*all_null_columns(df))


def split_internal(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Public table and timing table; internal columns start with an underscore."""
    internal = [c for c in df.columns if c.startswith("_")]
    return df.drop(*internal), df.select(*keys, *internal)


# --- coverage ---------------------------------------------------------------------------------
def coverage(df: DataFrame, bbox: str, seg: str, cp_bbox: str, cp_seg: str) -> DataFrame:
    std = F.col(bbox).isNotNull() & F.col(seg).isNotNull()
    cp = F.col(cp_bbox).isNotNull() & F.col(cp_seg).isNotNull()
    return df.withColumns({"has_std": std, "has_cp": cp})


def coverage_counts(flagged: DataFrame) -> DataFrame:
    s, c = F.col("has_std"), F.col("has_cp")
    n = lambda cond: F.count_if(cond)
    return flagged.agg(
        n(s & c).alias("n_both"), n(s & ~c).alias("n_std_only"), n(~s & c).alias("n_cp_only"), n(~s & ~c).alias("n_neither")
    )


def missing_labels(present: DataFrame, position: str, label: str, first: str | None = None) -> DataFrame:
    """(position, missing label): the labels of the first position are expected everywhere.

    Positions carry the array of labels they have, so no position × label product is built; the
    expected set is the label list of one position.
    """
    per = present.groupBy(position).agg(F.collect_set(label).alias("have"))
    start = per.agg(F.min_by("have", position)) if first is None else per.where(F.col(position) == first).select("have")
    expected = start.scalar()
    return per.withColumn("expected", expected).select(position, F.explode(F.array_except("expected", "have")).alias(label))


# --- deduplication ----------------------------------------------------------------------------
def dedupe_prefer_guide(cells: DataFrame, well: str, seg: str, guide: str, order: str) -> DataFrame:
    """One row per (well, segment): a valid guide wins, then the smallest order key. Rows without a segment stay."""
    known = cells.where(F.col(seg).isNotNull())
    best = first_row(known, [well, seg], [(~has_guide(F.col(guide))).cast("int"), F.col(order)])
    return best.unionByName(cells.where(F.col(seg).isNull()))


def duplicate_keys(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The worst repeated keys; empty when keys are unique."""
    ks = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return ks.where(F.col("n_rows") > 1).orderBy(F.col("n_rows").desc(), *keys).limit(n)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    worst = duplicate_keys(df, keys).collect()
    if worst:
        raise ValueError(f"repeated keys {list(keys)}: {[tuple(r) for r in worst]}")
    return df


def distinct_on_values(df: DataFrame, values: Sequence[str], order: str) -> DataFrame:
    """First row (by ``order``) of every distinct combination of values, with its other columns."""
    return first_row(df, list(values), [F.col(order)])


# --- hits -------------------------------------------------------------------------------------
def hits(stats: DataFrame, z: str = "z", p: str = "p_adj", z_min: float = 2.0, p_max: float = 0.05, fallback: int = 20, name: str = "feature") -> DataFrame:
    """Rows with |z| > z_min and p < p_max; if there are none, the ``fallback`` largest |z|. Ranked."""
    good = F.coalesce((F.abs(z) > z_min) & (F.col(p) < p_max), F.lit(False))
    n_good = stats.select(F.count_if(good)).scalar()
    order = [F.abs(z).desc_nulls_last(), F.col(name)]
    top = stats.orderBy(*order).limit(fallback).select(name).withColumn("__top", F.lit(True))
    picked = stats.join(top, name, "left").withColumn("__n", n_good).where(
        F.when(F.col("__n") > 0, good).otherwise(F.coalesce("__top", F.lit(False)))
    ).drop("__n", "__top")
    return picked.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def up_down_lists(stats: DataFrame, keys: Sequence[str], effect: str, name: str, n: int = 20, min_size: int = 5) -> DataFrame:
    """Per key the n most increased and n most decreased names; lists shorter than ``min_size`` go."""
    up = top_n(stats.where(F.col(effect) > 0), keys, [F.col(effect).desc(), F.col(name)], n).withColumn("direction", F.lit("up"))
    down = top_n(stats.where(F.col(effect) < 0), keys, [F.col(effect).asc(), F.col(name)], n).withColumn("direction", F.lit("down"))
    both = up.unionByName(down)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "direction"))
    return both.withColumn("__s", size).where(F.col("__s") >= min_size).drop("__s")


# --- deterministic sampling -------------------------------------------------------------------
def hash_order(ident: str | Column, seed: int = 42) -> Column:
    """A 60-bit order key from md5: the same draw in every run, engine and partitioning."""
    c = F.col(ident) if isinstance(ident, str) else ident
    text = F.concat_ws("|", c.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_per_stratum(df: DataFrame, strata: Sequence[str], ident: str, quota: DataFrame, seed: int = 42) -> DataFrame:
    """Exactly ``quota`` rows (column ``n_take``) of each stratum, the smallest hashes first.

    Ranks of hashes come from counted value ranges when a stratum is large, so no stratum has to
    be sorted by one task.
    """
    hashed = df.withColumn("__h", hash_order(ident, seed))
    ranks = value_ranks(hashed, strata, "__h").select(*strata, "__h", "n_below")
    kept = ranks.join(quota, list(strata)).where(F.col("n_below") < F.col("n_take")).select(*strata, "__h")
    return hashed.join(kept, [*strata, "__h"], "left_semi").drop("__h")


def equalise(df: DataFrame, side: str, ident: str, seed: int = 42) -> DataFrame:
    """Downsample every side to the size of the smallest one."""
    sizes = df.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    quota = sizes.withColumn("n_take", sizes.select(F.min("n")).scalar()).drop("n")
    return sample_per_stratum(df, [side], ident, quota, seed)


def proportional_sample(df: DataFrame, stratum: str, ident: str, total: int, minimum: int = 100, seed: int = 42) -> DataFrame:
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_rows = sizes.select(F.sum("n")).scalar()
    share = F.bround(F.col("n") / all_rows * F.lit(float(total)), 0).cast("long")
    quota = sizes.select(stratum, F.least(F.col("n"), F.greatest(F.lit(minimum).cast("long"), share)).alias("n_take"))
    return sample_per_stratum(df, [stratum], ident, quota, seed)


def balanced_sample(df: DataFrame, stratum: str, ident: str, total: int, seed: int = 42) -> DataFrame:
    """total // strata rows from each stratum."""
    strata = df.select(stratum).distinct()
    n = strata.select(F.count(F.lit(1))).scalar()
    quota = strata.withColumn("n_take", F.floor(F.lit(total) / n))
    return sample_per_stratum(df, [stratum], ident, quota, seed)


def capped_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    keyed = df.withColumn("__one", F.lit(0))
    quota = keyed.sparkSession.createDataFrame([(0, n)], "__one int, n_take long")
    return sample_per_stratum(keyed, ["__one"], ident, quota, seed).drop("__one")


def fraction_sample(df: DataFrame, ident: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.where(hash_order(ident, seed) < int(fraction * HASH_SPAN))


def objects_per_cell(objects: DataFrame, cell: str, label: Column, n: int, seed: int = 42) -> DataFrame:
    """At most n objects of each cell, drawn by hash; each task keeps n per cell before the shuffle."""
    h = hash_order(label, seed)
    return top_n(objects.withColumn("__h", h), [cell], [F.col("__h")], n, "__r").drop("__h", "__r")


def spatial_batches(cells: DataFrame, well: str, x: str, y: str, ident: str, size: int, chunk: int = 512) -> DataFrame:
    """Batch number of each cell in chunk order (chunk row, chunk column, y, x), missing coordinates last.

    The position is an offset per (chunk, pixel row), from counts alone, plus a rank inside it,
    so a well of any size is numbered without one task sorting it.
    """
    yy, xx = F.coalesce(F.col(y), F.lit(999999.0)), F.coalesce(F.col(x), F.lit(999999.0))
    keyed = cells.withColumns({
        "__cy": F.floor(yy / chunk), "__cx": F.floor(xx / chunk), "__fy": F.floor(yy), "__y": yy, "__x": xx,
    })
    cellkey = [well, "__cy", "__cx", "__fy"]
    counts = keyed.groupBy(*cellkey).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(well).orderBy("__cy", "__cx", "__fy").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(*cellkey).orderBy("__y", "__x", ident))
    numbered = keyed.join(offsets, cellkey).withColumn("position", F.col("__off") + local - 1)
    batch = F.floor(F.col("position") / size)
    safe = F.concat_ws("_", F.replace(F.col(well), F.lit("/"), F.lit("_")), F.lpad(batch.cast("string"), 4, "0"))
    return numbered.withColumn("batch_id", safe).drop("__cy", "__cx", "__fy", "__y", "__x", "__off")


def complexity(cells: DataFrame, bbox: str, seg: str, cp_bbox: str, cp_seg: str, n_network: int, percentile: float = 0.4) -> DataFrame:
    """50 for both segmentations + 20 · area / largest area + 5 per network structure; then a percentile split."""
    f = coverage(cells, bbox, seg, cp_bbox, cp_seg)
    area = F.greatest(F.coalesce(bbox_area(F.col(bbox)), F.lit(0)), F.coalesce(bbox_area(F.col(cp_bbox)), F.lit(0)))
    f = f.withColumn("__area", area.cast("double"))
    largest = f.select(F.max("__area")).scalar()
    score = (
        F.when(F.col("has_std") & F.col("has_cp"), 50.0).otherwise(0.0)
        + F.coalesce(F.try_divide(F.col("__area"), largest), F.lit(0.0)) * 20
        + F.when(F.col("has_std") | F.col("has_cp"), float(5 * n_network)).otherwise(0.0)
    )
    s = f.withColumn("score", score).drop("__area")
    from screenforge.operators.skew import quantiles

    cut = quantiles(s, [], "score", [percentile], "q").select(F.col("q")[0]).scalar()
    return s.withColumn("route", F.when(F.col("score") <= cut, "simple").otherwise("complex"))


def embedding_outliers(points: DataFrame, x: str, y: str, percentile: float = 0.92) -> DataFrame:
    """Points further from the centroid than the percentile of all distances."""
    from screenforge.operators.skew import quantiles

    c = points.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy")).select(F.struct("cx", "cy"))
    d = points.withColumn("__c", c.scalar())
    dx, dy = F.col(x) - F.col("__c.cx"), F.col(y) - F.col("__c.cy")
    d = d.withColumn("distance", F.sqrt(dx * dx + dy * dy)).drop("__c")
    cut = quantiles(d, [], "distance", [percentile], "q").select(F.col("q")[0]).scalar()
    return d.where(F.col("distance") > cut)


def highlight_genes(stats: DataFrame, gene: str, n: int, p: str | None = None, seed: int = 42) -> DataFrame:
    """n genes by hash order, or the n with the smallest minimum p."""
    if p is None:
        h = stats.select(gene).distinct().withColumn("order", hash_order(gene, seed))
    else:
        h = stats.groupBy(gene).agg(F.min(p).alias("order"))
    return h.orderBy("order", gene).limit(n)


# --- set operations ---------------------------------------------------------------------------
def jaccard(left: DataFrame, right: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """|intersection| / |union| of two key sets per group; 0 when both are empty."""
    ks = [*group, key]
    a = left.select(*ks).distinct().withColumn("a", F.lit(1))
    b = right.select(*ks).distinct().withColumn("b", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*ks).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n_both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.groupBy(*group).agg(
        n_both.alias("n_both"), F.count(F.lit(1)).alias("n_union"),
        F.coalesce(F.try_divide(n_both, F.count(F.lit(1))), F.lit(0.0)).alias("jaccard"),
    )


def overlap_classes(a: DataFrame, b: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """Per key: both, a_only, b_only or neither, by the boolean ``flag`` of two methods."""
    j = a.select(*key, F.col(flag).alias("__a")).join(b.select(*key, F.col(flag).alias("__b")), list(key), "full")
    fa, fb = F.coalesce("__a", F.lit(False)), F.coalesce("__b", F.lit(False))
    kind = F.when(fa & fb, "both").when(fa, "a_only").when(fb, "b_only").otherwise("neither")
    return j.withColumn("overlap", kind).drop("__a", "__b")
