"""Which feature groups carry a score: subsets, greedy removal and addition, and their tables.

A step's candidates are scored together in one job as named subsets of the same profiles; only
one number per candidate comes back to choose the next step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Groups = dict[str, Sequence[int]]
# (profiles, subsets) -> scores with columns variant, perturbation, mean_average_precision, …
Battery = Callable[[DataFrame, dict[str, Sequence[int]]], DataFrame]


def group_columns(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, feature): features named ``<label>_…`` of known labels; the rest under ``unknown (…)``.

    The label of a feature is what precedes its last ``_<digits>``.
    """
    base = F.regexp_replace("feature", r"_[^_]*?\d+$", "")
    f = features.withColumn("label", base).join(labels.select("label").distinct().withColumn("__known", F.lit(True)), "label", "left")
    named = F.when(F.col("__known"), F.col("label")).otherwise(F.concat(F.lit("unknown ("), F.col("label"), F.lit(")")))
    return f.select(named.alias("label"), "feature")


def _positions(groups: Groups, keep: Sequence[str]) -> list[int]:
    return sorted(i for k in keep for i in groups[k])


def subset_scores(profiles: DataFrame, groups: Groups, subsets: dict[str, Sequence[str]], battery: Battery) -> DataFrame:
    return battery(profiles, {name: _positions(groups, labels) for name, labels in subsets.items() if labels})


def _variant_means(scores: DataFrame, score: str) -> dict[str, float]:
    return {r["variant"]: r["s"] for r in scores.groupBy("variant").agg(F.avg(score).alias("s")).collect()}


def backward_elimination(profiles: DataFrame, groups: Groups, battery: Battery, score: str = "mean_average_precision") -> DataFrame:
    """(step, label, n_remaining, score): each step drops the label whose removal scores best.

    Ties go to the first label in alphabetical order. Step 0 is the full set.
    """
    spark = profiles.sparkSession
    remaining = sorted(groups)
    rows = [(0, "(none)", len(remaining), _variant_means(subset_scores(profiles, groups, {"full": remaining}, battery), score)["full"])]
    for step in range(1, len(groups)):
        got = _variant_means(subset_scores(profiles, groups, {c: [k for k in remaining if k != c] for c in remaining}, battery), score)
        best = None
        for c in remaining:
            if c in got and got[c] is not None and (best is None or got[c] > got[best]):
                best = c
        if best is None:
            break
        remaining.remove(best)
        rows.append((step, best, len(remaining), got[best]))
    return spark.createDataFrame(rows, "step int, label string, n_remaining int, score double")


def forward_selection(profiles: DataFrame, groups: Groups, battery: Battery, score: str = "mean_average_precision", first: str | None = None) -> DataFrame:
    """(step, label, n_selected, score): each step adds the label that scores best; the first can be forced."""
    spark = profiles.sparkSession
    chosen: list[str] = []
    rows = []
    for step in range(1, len(groups) + 1):
        candidates = [first] if step == 1 and first is not None else sorted(k for k in groups if k not in chosen)
        got = _variant_means(subset_scores(profiles, groups, {c: [*chosen, c] for c in candidates}, battery), score)
        best = None
        for c in candidates:
            if c in got and got[c] is not None and (best is None or got[c] > got[best]):
                best = c
        if best is None:
            break
        chosen.append(best)
        rows.append((step, best, len(chosen), got[best]))
    return spark.createDataFrame(rows, "step int, label string, n_selected int, score double")


def leave_one_out(profiles: DataFrame, groups: Groups, battery: Battery) -> DataFrame:
    """Per-perturbation scores of the full set (variant ``full``) and without each label, in one job."""
    labels = sorted(groups)
    return subset_scores(profiles, groups, {"full": labels, **{k: [x for x in labels if x != k] for k in labels}}, battery)


def perturbation_deltas(scores: DataFrame, baseline: str = "full", flag: str | None = "below_corrected_p") -> DataFrame:
    """(label, perturbation, baseline, ablated, delta, lost_significance) for each ablated variant."""
    cols = ["perturbation", "mean_average_precision"] + ([flag] if flag else [])
    b = scores.where(F.col("variant") == baseline).select(*[F.col(c).alias(c if c == "perturbation" else f"b_{c}") for c in cols])
    a = scores.where(F.col("variant") != baseline).select("variant", *cols)
    j = a.join(b, "perturbation")
    out = [
        F.col("variant").alias("label"), "perturbation", F.col("b_mean_average_precision").alias("baseline"), F.col("mean_average_precision").alias("ablated"),
        (F.col("b_mean_average_precision") - F.col("mean_average_precision")).alias("delta"),
    ]
    if flag:
        out.append((F.col(f"b_{flag}") & ~F.col(flag)).alias("lost_significance"))
    return j.select(*out)


def attribution_summary(summary: DataFrame, metrics: Sequence[str], ratios: Sequence[str], baseline: str = "full") -> DataFrame:
    """Baseline minus ablated for each score, with the mean over the ratio scores, largest first."""
    b = summary.where(F.col("variant") == baseline).select(F.struct(*metrics)).scalar()
    a = summary.where(F.col("variant") != baseline).withColumn("__b", b)
    out = a.select(F.col("variant").alias("label"), *metrics, *[(F.col(f"__b.{m}") - F.col(m)).alias(f"delta_{m}") for m in metrics])
    mean = sum((F.col(f"delta_{r}") for r in ratios), F.lit(0.0)) / len(ratios)
    return out.withColumn("avg_delta", mean).orderBy(F.col("avg_delta").desc(), "label")


def attribution_matrix(deltas: DataFrame, labels: Sequence[str]) -> DataFrame:
    return deltas.groupBy("perturbation").pivot("label", list(labels)).agg(F.first("delta")).fillna(0.0)


def dependency_table(deltas: DataFrame) -> DataFrame:
    return deltas.where("lost_significance").select("perturbation", "label", "baseline", "ablated", "delta").orderBy(F.col("delta").desc())
