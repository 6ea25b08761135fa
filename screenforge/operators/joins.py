"""Joins the screens need: enrichment, level alignment, ranges, label resolution, nearest values.

Nothing here hints a broadcast: AQE measures each side at run time and broadcasts only below its
own size threshold, and splits skewed partitions of the sort-merge joins that remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.functions.scalars import collapsed_key, fuzzy_key
from screenforge.operators.skew import first_row


def attach(features: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Left join with keys aligned to text on both sides."""
    l = features.withColumn(key, F.col(key).cast("string"))
    r = metadata.withColumn(key, F.col(key).cast("string"))
    return l.join(r, key, "left")


def align_frames(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Outer alignment of feature frames by one grouped union instead of a chain of full joins."""
    names: list[str] = []
    out = None
    for f in frames:
        names += [c for c in f.columns if c != key]
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def enrich_missing(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Fill nulls from a lookup; the last duplicate key (largest order) wins."""
    last = lookup.groupBy(key).agg(*[F.max_by(c, order).alias(f"__{c}") for c in columns])
    j = df.join(last, key, "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")) if c in df.columns else F.col(f"__{c}"))
    return j.drop(*[f"__{c}" for c in columns])


def compare_methods(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])

    return side(a, suffixes[0]).join(side(b, suffixes[1]), list(keys))


def grid_cells(df: DataFrame, keys: Sequence[str], x: str, y: str, width: Column, height: Column, x0: Column | None = None, y0: Column | None = None) -> DataFrame:
    """Range join against a regular grid as an equality: each row computes its own tile."""
    ox = F.col(x) if x0 is None else F.col(x) - x0
    oy = F.col(y) if y0 is None else F.col(y) - y0
    return df.withColumns({"grid_x": F.floor(ox / width), "grid_y": F.floor(oy / height)})


def category_join(scores: DataFrame, mapping: DataFrame, gene: str = "gene", multiple: bool = True) -> DataFrame:
    """Gene scores to categories; with a single mapping the first pass, then the name, decides."""
    if not multiple:
        mapping = first_row(mapping, [gene], [F.col("pass"), F.col("category")])
    return scores.join(mapping, gene)


def match_by_metric(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of features that share a metric; one feature per metric and side, the last by name."""
    one = lambda df, n: df.where(F.col("metric").isNotNull() & (F.col("metric") != "")).groupBy("metric").agg(F.max("feature").alias(n))
    return one(left, "left_feature").join(one(right, "right_feature"), "metric")


def shortest_match(names: DataFrame, patterns: DataFrame, name: str = "organelle", pattern: str = "pattern") -> DataFrame:
    """Per pattern the shortest name that contains it, case-insensitively; ties by name.

    Every substring of a name is an equality key, so the match is a hash join and not a scan of
    names × patterns. Names are identifiers, so their substrings are few.
    """
    low = F.lower(F.col(name))
    n = F.length(low)
    pieces = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(low, i, k))
    )))
    keyed = names.select(F.col(name), F.explode(pieces).alias("__k"))
    p = patterns.select(F.col(pattern), F.lower(F.col(pattern)).alias("__k")).distinct()
    return p.join(keyed, "__k").groupBy(pattern).agg(F.min_by(name, F.struct(F.length(name), F.col(name))).alias(name))


def fixed_stain_features(meta: DataFrame, organelle: str = "organelle") -> DataFrame:
    """Features of fixed-stain structures and of the two cell outlines."""
    o = F.col(organelle)
    stained = o.rlike("(?i)^cp[12]_") & ~o.rlike("phase2d_|focus3d_|nucleoli_phase2d|nucleoli_focus3d")
    return meta.where(stained & ~o.isin("nuclei", "nuclear_seg", "cell_seg") | o.isin("cell", "cp_cell"))


def stain_side(organelle: Column) -> Column:
    return F.when(F.lower(organelle).rlike("^cp[12]_"), "fixed").otherwise("other")


def mark_by_origin(df: DataFrame, reporter: str, channels: str) -> DataFrame:
    """Prefix CP_ where any channel of the comma list is a fixed-stain channel."""
    stained = F.exists(F.split(channels, ","), lambda c: F.trim(c).rlike("^CP[12]_"))
    return df.withColumn("reporter", F.when(stained, F.concat(F.lit("CP_"), F.col(reporter))).otherwise(F.col(reporter)))


def restrict_sets(sets: DataFrame, present: DataFrame, gene: str = "gene", minimum: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sets with the genes the data has (at least ``minimum``), and the genes it lacks per set."""
    have = present.select(gene).distinct()
    kept = sets.join(have, gene, "left_semi").groupBy("set_id").agg(
        F.sort_array(F.collect_set(gene)).alias("genes"), F.count_distinct(gene).alias("n_genes")
    ).where(F.col("n_genes") >= minimum)
    return kept, sets.join(have, gene, "left_anti").select("set_id", gene).distinct()


def resolve_labels(names: DataFrame, catalogue: DataFrame, overrides: DataFrame | None = None, name: str = "channel") -> DataFrame:
    """Biological label of a channel name by tiers; the first tier that hits wins and is recorded.

    ``catalogue`` holds (channel_name, label) where a label reads ``organelle, marker``. Tiers:
    channel name, exact marker, exact label, fuzzy marker, fuzzy label, collapsed marker,
    collapsed label, stain channel ``CP1_a_b``, overrides, unresolved. Each tier contributes its
    own key rows to one keyed table, so all tiers are a single equality join.
    """
    c = catalogue.withColumn("marker", F.when(F.col("label").contains(","), F.trim(F.split("label", ",", 2)[1])))
    tiers = [
        ("direct", F.col("channel_name"), "exact"), ("marker", F.col("marker"), "exact"), ("label", F.col("label"), "exact"),
        ("marker_fuzzy", fuzzy_key(F.col("marker")), "fuzzy"), ("label_fuzzy", fuzzy_key(F.col("label")), "fuzzy"),
        ("marker_collapsed", collapsed_key(F.col("marker")), "collapsed"), ("label_collapsed", collapsed_key(F.col("label")), "collapsed"),
    ]
    entries = F.array(*[
        F.struct(F.lit(i).alias("tier"), F.lit(m).alias("method"), F.lit(k).alias("form"), key.alias("key"))
        for i, (m, key, k) in enumerate(tiers)
    ])
    keyed = c.select("label", F.explode(entries).alias("e")).select("label", "e.*").where(F.col("key").isNotNull())
    if overrides is not None:
        fixed = overrides.select("label", F.lit(8).alias("tier"), F.lit("override").alias("method"), F.lit("exact").alias("form"), F.col(name).alias("key"))
        keyed = keyed.unionByName(fixed)
    best_keys = keyed.groupBy("form", "key").agg(F.min_by(F.struct("tier", "method", "label"), F.struct("tier", "label")).alias("hit"))
    n = F.col(name)
    forms = F.array(
        F.struct(F.lit("exact").alias("form"), n.alias("key")), F.struct(F.lit("fuzzy").alias("form"), fuzzy_key(n).alias("key")),
        F.struct(F.lit("collapsed").alias("form"), collapsed_key(n).alias("key")),
    )
    asked = names.select(name).distinct()
    found = asked.select(name, F.explode(forms).alias("f")).select(name, "f.*").join(best_keys, ["form", "key"]).select(name, "hit")
    parts = F.split(n, "_", 3)
    stain = n.rlike("^CP[12]_") & (F.size(parts) == 3)
    guess = asked.select(name, F.when(stain, F.struct(
        F.lit(7).alias("tier"), F.lit("stain").alias("method"), F.concat_ws(", ", parts[1], F.try_element_at(parts, F.lit(3))).alias("label")
    )).otherwise(F.struct(F.lit(9).alias("tier"), F.lit("unresolved").alias("method"), F.concat(F.lit("(unmapped: "), n, F.lit(")")).alias("label"))).alias("hit"))
    return found.unionByName(guess).groupBy(name).agg(F.min("hit").alias("h")).select(name, "h.label", "h.method")


def channel_of_label(labels: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel index of each segmentation label by tiers; within a tier the first index wins.

    ``channels`` is the channel list of one experiment: it is reduced to a single array, so each
    label looks its channel up in a row-local expression.
    """
    norm = lambda c: F.regexp_replace(F.replace(F.lower(c), F.lit(","), F.lit("")), "[ -]", "_")
    listed = channels.agg(F.sort_array(F.collect_list(F.struct("index", F.lower("channel").alias("low"), norm(F.col("channel")).alias("norm"))))).scalar()
    l = F.lower(F.col("label"))
    base = F.substring(l, 5, 1000)
    pre = F.substring(l, 1, 4)
    tests = [
        lambda c: (c["norm"] == l) | F.contains(c["norm"], l) | F.contains(l, c["norm"]),
        lambda c: pre.isin("cp1_", "cp2_") & c["low"].startswith(pre) & (F.contains(c["low"], base) | F.substring(c["low"], 5, 1000).startswith(F.substring(base, 1, 4))),
        lambda c: (F.contains(l, F.lit("phase2d")) | l.startswith("phase")) & F.contains(c["low"], F.lit("phase")),
        lambda c: (F.contains(l, F.lit("focus3d")) | l.startswith("focus")) & F.contains(c["low"], F.lit("focus")),
        lambda c: F.contains(l, F.lit("nucleoli")) & F.contains(l, F.lit("phase")) & F.contains(c["low"], F.lit("phase")),
        lambda c: F.contains(l, F.lit("nucleoli")) & F.contains(l, F.lit("focus")) & F.contains(c["low"], F.lit("focus")),
    ]
    cand = [F.try_element_at(F.filter("__ch", t), F.lit(1))["index"] for t in tests]
    return labels.withColumn("__ch", listed).withColumn("channel_index", F.coalesce(*cand)).drop("__ch")


def majority_label(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per key, ties to the smallest label."""
    c = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*key).agg(F.min_by(label, F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))).alias(label), F.max("n").alias("n"))
