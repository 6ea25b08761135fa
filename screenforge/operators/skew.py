"""Exact order statistics that hold when one group has a large share of all rows.

Each operator first bounds the size of the largest group: by the row count, and where that is
above the limit by a map-side combined count on the key columns only. Up to the session's group limit the built-in aggregate or window is
used. Beyond it, the group is cut into value ranges whose bounds come from a mergeable sketch,
ranks are counted per range, and only range totals meet in one place. Both ways give the same,
exact answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.session import group_limit

SKETCH_ACCURACY = 10_000
RANGES = 256


def largest_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> int:
    """Rows of the largest group, or the number of all rows where that already is within the limit.

    Counting rows needs no shuffle, so small inputs never pay for the grouped count.
    """
    limit = group_limit(df.sparkSession) if limit is None else limit
    n = df.count()
    if not keys or n <= limit:
        return n
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key columns where null equals null; the keys appear once, from the left side."""
    same = [F.col(f"__l.`{k}`").eqNullSafe(F.col(f"__r.`{k}`")) for k in keys]
    joined = left.alias("__l").join(right.alias("__r"), same, how)
    more = [] if how in ("left_anti", "left_semi") else [F.col(f"__r.`{c}`") for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"__l.`{c}`") for c in left.columns], *more)


def join_groups(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], size: str, how: str = "inner", nulls: bool = False,
) -> DataFrame:
    """``rows`` with the columns of ``stats``, one row per group; ``size`` is the group's number of rows and is dropped.

    Groups beyond the limit, of which there are at most rows / limit, go to every task, and their rows
    are dealt evenly; only the others meet by key, so no task gets more than one of those and its share.
    Keys come first. A null key matches nothing, or with ``nulls`` the null key.
    """
    limit = group_limit(rows.sparkSession)
    values = [c for c in stats.columns if c not in (*keys, size)]
    known = stats if nulls else stats.dropna(subset=list(keys))
    packed = lambda part, name: part.select(*keys, F.struct(*values).alias(name))
    hot = packed(known.where(F.col(size) > limit), "__hot")
    away = F.col("__hot").isNotNull()
    for k in [] if nulls else keys:
        away = away | F.col(k).isNull()
    deal = F.when(away, F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).otherwise(0).alias("__deal")
    dealt = join_keys(rows, F.broadcast(hot), keys, "left").select("*", deal)
    cold = packed(known.where(F.col(size) <= limit), "__cold").withColumn("__deal", F.lit(0).cast("long"))
    met = join_keys(dealt, cold, [*keys, "__deal"], "left").withColumn("__stats", F.coalesce("__hot", "__cold"))
    if how == "inner":
        met = met.where(F.col("__stats").isNotNull())
    return met.select(*keys, *[c for c in rows.columns if c not in keys], *[F.col("__stats")[v].alias(v) for v in values])


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(0)), ["__all"])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], alias: str = "quantiles",
    limit: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group as an array column; null values are skipped."""
    df, ks = _with_key(df.where(F.col(value).isNotNull()), keys)
    limit = group_limit(df.sparkSession) if limit is None else limit
    sizes = df.groupBy(*ks).agg(F.count(value).alias("__n"))
    probs = [float(p) for p in probs]
    direct = F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias(alias)
    if largest_group(df, ks, limit) <= limit:
        out = df.groupBy(*ks).agg(direct)
    else:
        # at most rows / limit groups: by a shuffle all rows of one would come to one task
        hot = F.broadcast(sizes.where(F.col("__n") > limit))
        small = join_keys(df, hot, ks, "left_anti").groupBy(*ks).agg(direct)
        out = small.unionByName(_bracketed_quantiles(df, ks, value, probs, alias, hot))
    return out.drop("__all")


def _bracketed_quantiles(df, ks, value, probs, alias, hot) -> DataFrame:
    """Hot groups: a sketch brackets each wanted rank, counts make it exact.

    Between the two bracket values lie about 6 / SKETCH_ACCURACY of the group's rows; only
    their distinct values are ordered, everything below is counted.
    """
    eps = 3.0 / SKETCH_ACCURACY
    rows = join_keys(df, hot, ks)
    bounds = []
    for p in probs:
        bounds += [max(0.0, p - eps), min(1.0, p + eps)]
    sketch = rows.groupBy(*ks).agg(
        F.percentile_approx(value, [float(b) for b in bounds], SKETCH_ACCURACY).alias("__b"),
        F.min(value).alias("__min"), F.max(value).alias("__max"), F.first("__n").alias("__n"),
    )
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (F.col("__min") if p - eps <= 0 else F.col("__b")[2 * i]).alias("lo"),
            (F.col("__max") if p + eps >= 1 else F.col("__b")[2 * i + 1]).alias("hi"),
            (F.lit(p) * (F.col("__n") - 1)).alias("pos"),
        ) for i, p in enumerate(probs)
    ])
    near = join_keys(rows.drop("__n"), F.broadcast(sketch.select(*ks, wanted.alias("__w"))), ks)
    parts = near.select(*ks, F.col(value).alias("__v"), F.explode("__w").alias("w")).where(
        F.col("__v") <= F.col("w.hi")
    )
    counted = parts.groupBy(
        *ks, "w", F.when(F.col("__v") >= F.col("w.lo"), F.col("__v")).alias("__v")
    ).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*ks, "w.i").orderBy(F.col("__v").asc_nulls_first())
    cum = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.col("w.pos")
    at = lambda r: F.min(F.when((F.col("upto") > r) & F.col("__v").isNotNull(), F.col("__v")))
    one = cum.groupBy(*ks, F.col("w.i").alias("i")).agg(
        at(F.floor(pos)).alias("a"), at(F.ceil(pos)).alias("b"),
        F.first(pos - F.floor(pos)).alias("frac"),
    )
    pick = F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("q"))
    return one.groupBy(*ks).agg(
        F.transform(F.sort_array(F.collect_list(pick)), lambda s: s["q"]).alias(alias)
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """Distinct (keys…, value) with ``n_below``, ``n_equal`` and ``n_total``.

    Average rank is ``n_below + (n_equal + 1) / 2``, the number of rows at or below is
    ``n_below + n_equal``. Rows are combined per distinct value before any ordering.
    """
    limit = group_limit(df.sparkSession) if limit is None else limit
    present, ks = _with_key(df.where(F.col(value).isNotNull()), keys)
    return _value_ranks(df, keys, value, limit, largest_group(present, ks, limit) > limit)


def _value_ranks(df: DataFrame, keys: Sequence[str], value: str, limit: int, large: bool) -> DataFrame:
    df, ks = _with_key(df.where(F.col(value).isNotNull()), keys)
    counts = df.groupBy(*ks, value).agg(F.count(F.lit(1)).alias("n_equal"))
    if not large:
        run = Window.partitionBy(*ks).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = counts.withColumn("n_below", F.coalesce(F.sum("n_equal").over(run), F.lit(0))).withColumn(
            "n_total", F.sum("n_equal").over(Window.partitionBy(*ks))
        )
    else:
        out = _ranged_ranks(counts, ks, value, limit)
    return out.drop("__all")


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES, limit: int | None = None) -> DataFrame:
    """Adds ``__range``: the index of the sketch-balanced value range of each row in its group; 0 in groups within the limit."""
    limit = group_limit(df.sparkSession) if limit is None else limit
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, cuts, SKETCH_ACCURACY).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    # at most rows / limit groups have ranges
    joined = join_keys(df, F.broadcast(bounds.where(F.col("__n") > limit).drop("__n")), keys, "left")
    # binary search for the number of cuts below the value
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((ranges - 1).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("__cuts", at + step - 1) < F.col(value), step).otherwise(0))
    return joined.withColumn("__range", below).drop("__cuts")


def _ranged_ranks(counts: DataFrame, ks: list[str], value: str, limit: int) -> DataFrame:
    ranged = value_ranges(counts, ks, value, limit=limit)
    per_range = ranged.groupBy(*ks, "__range").agg(F.sum("n_equal").alias("__c"))
    before = Window.partitionBy(*ks).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *ks, "__range",
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"),
        F.sum("__c").over(Window.partitionBy(*ks)).alias("n_total"),
    )
    run = Window.partitionBy(*ks, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum("n_equal").over(run), F.lit(0)))
    return join_keys(local, offsets, [*ks, "__range"]).select(
        *ks, value, "n_equal", (F.col("__off") + F.col("__local")).alias("n_below"), "n_total"
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, alias: str, limit: int | None = None) -> DataFrame:
    """Rank with ties averaged; a null value has no rank and shifts none, a null key is a group."""
    return average_ranks(df, keys, {value: alias}, limit)


def average_ranks(df: DataFrame, keys: Sequence[str], values: dict[str, str], limit: int | None = None) -> DataFrame:
    """``average_rank`` of several columns, given as {value: alias}.

    Small groups rank in place; otherwise ranks join back by value, all of them counted on ``df`` itself.
    """
    limit = group_limit(df.sparkSession) if limit is None else limit
    if largest_group(df, keys, limit) <= limit:
        out = df
        for value, alias in values.items():
            w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
            ties = Window.partitionBy(*keys, value)
            rank = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2
            out = out.withColumn(alias, F.when(F.col(value).isNotNull(), rank))
        return out
    out = df
    for value, alias in values.items():
        ranks = _value_ranks(df, keys, value, limit, True).select(
            *keys, value, "n_equal", (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias(alias)
        )
        out = join_groups(out, ranks, [*keys, value], "n_equal", "left", nulls=True).select(*out.columns, alias)
    return out


def bh_adjust(df: DataFrame, keys: Sequence[str], p: str, alias: str = "p_adj", limit: int | None = None) -> DataFrame:
    """Benjamini–Hochberg within each group; a null p counts as 1.

    The adjusted value is the smallest p·m/rank over all p at least as large, capped at 1.
    """
    limit = group_limit(df.sparkSession) if limit is None else limit
    df = df.withColumns({"__p": F.coalesce(F.col(p), F.lit(1.0)), "__set": F.lit(0)})
    ks = [*keys, "__set"]
    if largest_group(df, ks, limit) <= limit:
        w = Window.partitionBy(*ks)
        at_or_below = F.count(F.lit(1)).over(w.orderBy("__p").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        raw = df.withColumn("__raw", F.least(F.lit(1.0), F.col("__p") * F.count(F.lit(1)).over(w) / at_or_below))
        up = w.orderBy(F.col("__p").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return raw.withColumn(alias, F.min("__raw").over(up)).drop("__p", "__set", "__raw")
    ranks = value_ranks(df, ks, "__p", limit).withColumn(
        "__raw", F.least(F.lit(1.0), F.col("__p") * F.col("n_total") / (F.col("n_below") + F.col("n_equal")))
    )
    ranged = value_ranges(ranks, ks, "__p", limit=limit)
    above = Window.partitionBy(*ks).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = ranged.groupBy(*ks, "__range").agg(F.min("__raw").alias("__m")).select(
        *ks, "__range", F.min("__m").over(above).alias("__later")
    )
    up = Window.partitionBy(*ks, "__range").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adj = join_keys(ranged.withColumn("__here", F.min("__raw").over(up)), later, [*ks, "__range"]).select(
        *ks, "__p", F.least("__here", "__later").alias(alias)
    )
    return join_keys(df, adj, [*ks, "__p"]).drop("__p", "__set")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each group in the given order, as one combinable aggregate.

    ``min`` over a struct combines before the shuffle, so a hot key moves one row per task.
    Order columns must sort ascending and tell rows apart.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, alias: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the filter on the rank lets each task keep n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(alias, F.row_number().over(w)).where(F.col(alias) <= n)
