"""Embedding, neighbours and clustering on profile vectors (id, features array)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenforge.operators import pairs as PR
from screenforge.operators.communities import modularity_communities
from screenforge.operators.density import density_hierarchy
from screenforge.operators.graph import connected_components
from screenforge.operators.longform import array_to_long
from screenforge.operators.records import hash_order
from screenforge.operators.skew import average_rank, first_row
from screenforge.operators.ward import ward_subclusters
from screenforge.operators.windows import components_to_reach, min_max_composite
from screenforge.session import checkpointed, stored


# --- principal components ---------------------------------------------------------------------
def pca(profiles: DataFrame, k: int, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, variance, loadings) of the standardised features.

    The scatter matrix is summed over partitions; only d × d numbers reach the driver. The sign
    of each component makes its largest loading positive.
    """
    spark = profiles.sparkSession
    v = profiles.select("id", *keep, array_to_vector("features").alias("__raw"))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__x").fit(v).transform(v)
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(scaled)
    load = model.pc.toArray()
    sign = np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    signs = F.array(*[F.lit(float(s)) for s in sign])
    scores = model.transform(scaled).select("id", *keep, F.zip_with(vector_to_array("__pc"), signs, lambda a, s: a * s).alias("features"))
    shares = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    variance = spark.createDataFrame(shares, "component int, share double")
    rows = [(int(f), int(c + 1), float(load[f, c] * sign[c])) for f in range(load.shape[0]) for c in range(load.shape[1])]
    return scores, variance, spark.createDataFrame(rows, "dim int, component int, loading double")


def variance_summary(variance: DataFrame) -> DataFrame:
    return variance.agg(
        F.max(F.when(F.col("component") == 1, F.col("share"))).alias("pc1"), F.sum(F.when(F.col("component") <= 10, F.col("share"))).alias("first_ten"),
        F.sum("share").alias("total"),
    )


def pca_to_threshold(guides: DataFrame, genes: DataFrame, k_max: int, threshold: float = 0.95) -> tuple[DataFrame, DataFrame, int]:
    """Fit on guides, keep the fewest components reaching the threshold, apply to guides and genes."""
    v = guides.select("id", array_to_vector("features").alias("__raw"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__x").fit(v)
    model = PCA(k=k_max, inputCol="__x", outputCol="__pc").fit(scaler.transform(v))
    shares = np.cumsum(model.explainedVariance.toArray())
    k = int(min(np.searchsorted(shares, threshold - 1e-12) + 1, len(shares)))

    def apply(df: DataFrame) -> DataFrame:
        x = scaler.transform(df.withColumn("__raw", array_to_vector("features")))
        cut = F.slice(vector_to_array("__pc"), 1, k)
        return model.transform(x).withColumn("features", cut).drop("__raw", "__x", "__pc")

    return apply(guides), apply(genes), k


def effective_dimension(profiles: DataFrame, groups: dict[str, Sequence[int]], threshold: float = 0.9) -> DataFrame:
    """Components needed to reach the threshold in each feature group."""
    out = None
    for name, dims in groups.items():
        part = profiles.select("id", F.array(*[F.col("features")[d] for d in dims]).alias("features"))
        _, variance, _ = pca(part, len(dims))
        one = components_to_reach(variance.withColumn("side", F.lit(name)), ["side"], "component", "share", threshold)
        out = one if out is None else out.unionByName(one)
    return out


def cross_redundancy(profiles: DataFrame, a: Sequence[int], b: Sequence[int], k: int = 20) -> DataFrame:
    """Largest and mean |correlation| between the leading components of two feature groups."""
    pick = lambda dims: profiles.select("id", F.array(*[F.col("features")[d] for d in dims]).alias("features"))
    sa, sb = pca(pick(a), k)[0], pca(pick(b), k)[0]
    both = sa.join(sb.select("id", F.col("features").alias("__b")), "id").select(array_to_vector(F.concat("features", "__b")).alias("v"))
    m = np.abs(Correlation.corr(both, "v").first()[0].toArray()[:k, k:])
    return profiles.sparkSession.createDataFrame([(float(np.nanmax(m)), float(np.nanmean(m)))], "max_correlation double, mean_correlation double")


def group_embeddings(profiles: DataFrame, groups: dict[str, Sequence[int]], k: int) -> DataFrame:
    """(organelle, id, features): leading components of each group's own features."""
    out = None
    for name, dims in groups.items():
        part = profiles.select("id", F.array(*[F.col("features")[d] for d in dims]).alias("features"))
        s = pca(part, min(k, len(dims)))[0].withColumn("organelle", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


# --- k-means ----------------------------------------------------------------------------------
def _vectors(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("__v", array_to_vector("features"))


def kmeans_elbow(profiles: DataFrame, k_min: int = 2, k_max: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Labels at the k furthest from the chord of the cost curve, and the curve. One row gives label -1."""
    v = _vectors(profiles).persist()
    spark = profiles.sparkSession
    n = v.count()
    if n <= 1:
        return profiles.withColumn("cluster", F.lit(-1)), spark.createDataFrame([], "k int, cost double")
    costs = []
    for k in range(k_min, min(k_max, n - 1) + 1):
        costs.append((k, float(KMeans(k=k, seed=seed, featuresCol="__v").fit(v).summary.trainingCost)))
    ks, cs = np.array([c[0] for c in costs], float), np.array([c[1] for c in costs])
    x = (ks - ks[0]) / max(ks[-1] - ks[0], 1e-12)
    y = (cs - cs[-1]) / max(cs[0] - cs[-1], 1e-12)
    best = int(ks[int(np.argmax(np.abs(1 - x - y)))])
    labels = KMeans(k=best, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")
    return labels, spark.createDataFrame(costs, "k int, cost double")


def kmeans_by_silhouette(profiles: DataFrame, ks: Sequence[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    v = _vectors(profiles).persist()
    tried = []
    for k in ks:
        p = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v)
        tried.append((k, float(ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(p))))
    best = max(tried, key=lambda t: (t[1], -t[0]))[0]
    labels = KMeans(k=best, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")
    return labels, profiles.sparkSession.createDataFrame(tried, "k int, silhouette double")


# pluggable clusterers: name -> function of (profiles, options) giving a cluster column
CLUSTERERS: dict[str, Callable[..., DataFrame]] = {}


def clusterer(name: str):
    def add(fn):
        CLUSTERERS[name] = fn
        return fn

    return add


@clusterer("kmeans")
def _kmeans(profiles: DataFrame, **options) -> DataFrame:
    return kmeans_elbow(profiles, **options)[0]


@clusterer("silhouette")
def _silhouette(profiles: DataFrame, **options) -> DataFrame:
    return kmeans_by_silhouette(profiles, **options)[0]


@clusterer("ward")
def _ward(profiles: DataFrame, share: float = 0.5) -> DataFrame:
    found = ward_subclusters(profiles.select("id", "features", F.lit(0).alias("cluster")), share)
    return found.select("id", F.col("subcluster").alias("cluster"))


# --- density and communities ------------------------------------------------------------------
@clusterer("density")
def density_clusters(profiles: DataFrame, eps: float, min_samples: int = 5, min_size: int = 25, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(id, cluster): components of core points within ``eps``, border points to their nearest core.

    The cluster is the smallest id of its core; clusters below ``min_size`` and other points are
    noise (null). Dense neighbourhoods leave a tile as a spanning forest, never as pairs.
    """
    pts = profiles.select("id", "features")
    n = checkpointed(PR.neighbour_counts(pts, eps, block_rows))
    core = pts.join(n.where(F.col("n") >= min_samples).select("id"), "id", "left_semi")
    edges = PR.neighbour_forest(core, core, eps, block_rows)
    linked = connected_components(edges.union(core.select("id", F.col("id").alias("dst"))).toDF("src", "dst"))
    roots = checkpointed(linked.select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    rest = pts.join(roots, "id", "left_anti")
    near = PR.nearest(rest, core, 1, block_rows=block_rows).where(F.col("distance") <= eps)
    border = near.join(roots.select(F.col("id").alias("ref_id"), "cluster"), "ref_id").select("id", "cluster")
    labelled = roots.unionByName(border)
    kept = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_size).select("cluster")
    return pts.select("id").join(labelled.join(kept, "cluster", "left_semi"), "id", "left").select("id", "cluster")


clusterer("density_hierarchy")(density_hierarchy)


def knn_graph(profiles: DataFrame, k: int) -> DataFrame:
    """Undirected weighted edges (src < dst, weight = 1 / (distance + 1e-10)) of the k nearest neighbours."""
    nn = PR.nearest(profiles, profiles, k)
    e = nn.select(F.least("id", "ref_id").alias("src"), F.greatest("id", "ref_id").alias("dst"), (1 / (F.col("distance") + F.lit(1e-10))).alias("weight"))
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) of the largest modularity that merging and moving reach; see ``operators.communities``."""
    return modularity_communities(edges, resolution)


@clusterer("communities")
def _communities(profiles: DataFrame, k: int = 15, resolution: float = 1.0) -> DataFrame:
    return communities(stored(knn_graph(profiles, k)), resolution).withColumnRenamed("community", "cluster")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = e.select(F.col("ca").alias("c"), "weight").union(e.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    m = edges.select(F.sum("weight")).scalar()
    q = ends.join(inside, "c", "left").withColumn("m", m)
    part = F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))
    return q.agg(F.sum(part).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


def propagate_labels(labelled: DataFrame, rest: DataFrame, label: str) -> DataFrame:
    """Label of the nearest labelled row for every other row."""
    nn = PR.nearest(rest, labelled, 1, [label], exclude_same_id=False)
    return nn.select("id", F.col(f"ref_{label}").alias(label), "distance")


# --- validation -------------------------------------------------------------------------------
def silhouette(profiles: DataFrame, group: str, block_rows: int = PR.BLOCK_ROWS) -> DataFrame:
    """(id, group, a, b, silhouette): exact, from per-group distance sums. A lone member scores 0."""
    rows = profiles.where(F.col(group).isNotNull())
    d = PR.group_distances(rows, rows, group, block_rows).join(rows.select("id", F.col(group).cast("string").alias("__g")), "id")
    own = F.col("ref_group") == F.col("__g")
    s = d.groupBy("id", F.col("__g").alias(group)).agg(
        F.max(F.when(own, F.col("total") / F.col("n"))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b")
    )
    v = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return s.withColumn("silhouette", F.coalesce(v, F.lit(0.0)))


def cluster_sizes_and_silhouette(profiles: DataFrame, group: str) -> DataFrame:
    return silhouette(profiles, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))


def set_silhouettes(profiles: DataFrame, group: str, spaces: dict[str, Sequence[int]]) -> DataFrame:
    """One-vs-rest silhouette of each group in two feature spaces, and the difference.

    One-vs-rest means: distance to own members against the mean distance to all other rows.
    """
    out = None
    for name, dims in spaces.items():
        p = profiles.select("id", group, F.array(*[F.col("features")[d] for d in dims]).alias("features"))
        d = PR.group_distances(p, p, group).join(p.select("id", F.col(group).cast("string").alias("__g")), "id")
        own = F.col("ref_group") == F.col("__g")
        part = lambda c: F.try_divide(F.sum(F.when(c, F.col("total"))), F.sum(F.when(c, F.col("n"))))
        s = d.groupBy("id", "__g").agg(part(own).alias("a"), part(~own).alias("b"))
        v = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
        one = s.groupBy(F.col("__g").alias(group)).agg(F.avg(v).alias(f"silhouette_{name}"))
        out = one if out is None else out.join(one, group)
    x, y = list(spaces)
    return out.withColumn("difference", F.col(f"silhouette_{x}") - F.col(f"silhouette_{y}"))


def centroid_vectors(profiles: DataFrame, group: str) -> DataFrame:
    """(id = group, features): mean vector per group from combinable per-dimension averages."""
    long = array_to_long(profiles.select(group, "features"), [group], "features")
    m = long.groupBy(group, "dim").agg(F.avg("value").alias("value"))
    vec = F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"])
    return m.groupBy(F.col(group).alias("id")).agg(vec.alias("features"))


def centroid_distances(profiles: DataFrame, group: str) -> DataFrame:
    """Mean distance between centroids, mean distance of rows to their own centroid, and their ratio."""
    c = centroid_vectors(profiles, group)
    inter = PR.group_distances(c.withColumn("one", F.lit("x")), c.withColumn("one", F.lit("x")), "one").select((F.sum("total") / F.sum("n")).alias("inter"))
    diff = F.zip_with("features", "__c", lambda a, b: (a - b) * (a - b))
    own = profiles.join(c.select(F.col("id").alias(group), F.col("features").alias("__c")), group)
    intra = own.agg(F.avg(F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v))).alias("intra"))
    return intra.withColumn("inter", inter.scalar()).select("inter", "intra", F.try_divide(F.col("inter"), F.col("intra")).alias("ratio"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labelings, arithmetic mean of the entropies."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = c.groupBy(a).agg(F.sum("n").alias("na")), c.groupBy(b).agg(F.sum("n").alias("nb"))
    total = c.select(F.sum("n")).scalar()
    j = c.join(ra, a).join(rb, b).withColumn("t", total)
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    h = lambda col: F.sum(-F.col("n") / F.col("t") * F.log(F.col(col) / F.col("t")))
    s = j.agg(mi.alias("mi"), h("na").alias("ha"), h("nb").alias("hb"))
    return s.select("mi", F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))


def knn_accuracy(profiles: DataFrame, label: str, k: int = 5, folds: int = 3, seed: int = 42) -> DataFrame:
    """(fold, n, accuracy) of majority voting among the k nearest rows of the other folds, ties to the smallest label."""
    p = profiles.withColumn("__f", F.pmod(hash_order("id", seed), F.lit(folds)).cast("int"))
    votes = None
    for f in range(folds):
        nn = PR.nearest(p.where(F.col("__f") == f), p.where(F.col("__f") != f), k, [label]).withColumn("fold", F.lit(f))
        votes = nn if votes is None else votes.unionByName(nn)
    c = votes.groupBy("fold", "id", f"ref_{label}").agg(F.count(F.lit(1)).alias("v"))
    won = c.groupBy("fold", "id").agg(F.min_by(f"ref_{label}", F.struct((-F.col("v")).alias("a"), F.col(f"ref_{label}").alias("b"))).alias("guess"))
    return won.join(profiles.select("id", label), "id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy")
    )


def neighbour_purity(profiles: DataFrame) -> DataFrame:
    """1 - mean nearest distance / mean distance of all pairs, at least 0 (one row per class)."""
    nn = PR.nearest(profiles, profiles, 1).agg(F.avg("distance").alias("nearest"))
    p = profiles.withColumn("one", F.lit("x"))
    al = PR.group_distances(p, p, "one").select(F.sum("total") / F.sum("n")).scalar()
    return nn.withColumn("all_pairs", al).select("nearest", "all_pairs", F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("nearest"), F.col("all_pairs"))).alias("purity"))


def inter_group_distance(profiles: DataFrame, group: str) -> DataFrame:
    """Mean distance between rows of different groups over the largest distance of any pair."""
    d = PR.group_distances(profiles, profiles, group).join(profiles.select("id", F.col(group).cast("string").alias("__g")), "id")
    other = F.col("ref_group") != F.col("__g")
    s = d.agg(
        (F.sum(F.when(other, F.col("total"))) / F.sum(F.when(other, F.col("n")))).alias("mean_inter"), F.max("largest").alias("largest")
    )
    return s.withColumn("score", F.try_divide(F.col("mean_inter"), F.col("largest")))


def discrimination_ranking(profiles: DataFrame, group: str, spaces: dict[str, Sequence[int]]) -> DataFrame:
    """Feature groups ranked by the mean of their scaled separation scores."""
    out = None
    for name, dims in spaces.items():
        p = profiles.select("id", group, F.array(*[F.col("features")[d] for d in dims]).alias("features"))
        one = centroid_distances(p, group).select(F.lit(name).alias("organelle"), "ratio").join(
            inter_group_distance(p, group).select(F.lit(name).alias("organelle"), F.col("score").alias("separation")), "organelle"
        ).join(silhouette(p, group).agg(F.avg("silhouette").alias("silhouette")).withColumn("organelle", F.lit(name)), "organelle")
        out = one if out is None else out.unionByName(one)
    return min_max_composite(out, "organelle", ["ratio", "separation", "silhouette"])


def cohesion(profiles: DataFrame, sets: DataFrame, gene: str = "gene", seed: int = 42) -> DataFrame:
    """Per set of genes: mean distance of its gene centroids against all pairs of rows, and against
    ten times as many hash-drawn rows. Cohesion is 1 - intra / all, held within [0, 1]."""
    p = profiles.withColumn("__one", F.lit("x"))
    base = PR.group_distances(p, p, "__one").select(F.sum("total") / F.sum("n")).scalar()
    c = centroid_vectors(profiles, gene)
    m = sets.select("set_id", F.col(gene).alias("__g")).distinct().join(c.withColumnRenamed("id", "__g"), "__g")
    member = m.select(F.concat_ws("|", F.col("set_id").cast("string"), F.col("__g").cast("string")).alias("id"), F.col("set_id").cast("string").alias("s"), "features")
    # members meet every set's members in tiles; only their own set's sum is kept
    intra = PR.group_distances(member, member, "s").join(member.select("id", "s"), "id").where("ref_group = s").groupBy("s").agg(
        (F.sum("total") / F.sum("n")).alias("intra"), (F.count(F.lit(1))).alias("n_genes"))
    order = Window.orderBy(hash_order("id", seed))
    sizes = member.groupBy("s").agg((F.count(F.lit(1)) * 10).alias("want"))
    most = sizes.select(F.max("want")).first()[0] or 0
    drawn = profiles.select("id", "features").orderBy(hash_order("id", seed)).limit(int(most))
    numbered = checkpointed(drawn.withColumn("__rn", F.row_number().over(order)))
    # each wanted sample size is one prefix of the draw; prefixes are nested, so steps add up
    steps = [r["want"] for r in sizes.select("want").distinct().orderBy("want").collect()]
    bucket = F.lit(len(steps))
    for i, w in reversed(list(enumerate(steps))):
        bucket = F.when(F.col("__rn") <= w, F.lit(i)).otherwise(bucket)
    refs = numbered.select(F.col("id").cast("string").alias("id"), "features", bucket.alias("step"))
    far = PR.group_distances(member.select("id", "features"), refs, "step").join(member.select("id", "s"), "id").join(sizes, "s")
    limit = F.element_at(F.array(*[F.lit(int(w)) for w in steps]), F.col("ref_group").cast("int") + 1)
    inter = far.where(limit <= F.col("want")).groupBy("s").agg((F.sum("total") / F.sum("n")).alias("inter"))
    j = intra.where("n_genes >= 2").join(inter, "s").withColumn("all_pairs", base)
    held = F.least(F.greatest(1 - F.try_divide(F.col("intra"), F.col("all_pairs")), F.lit(0.0)), F.lit(1.0))
    return j.select(
        F.col("s").alias("set_id"), "n_genes", "intra", "all_pairs", F.coalesce(held, F.lit(0.0)).alias("cohesion"),
        F.coalesce(F.try_divide(F.col("inter") - F.col("intra"), F.greatest("inter", "intra")), F.lit(0.0)).alias("silhouette_like"),
    )


def cohesion_per_space(profiles: DataFrame, sets: DataFrame, groups: dict[str, Sequence[int]], gene: str = "gene", k: int = 10) -> DataFrame:
    """Mean and deviation over sets of the cohesion in each feature group's leading components."""
    out = None
    for name, dims in groups.items():
        part = profiles.select("id", gene, F.array(*[F.col("features")[d] for d in dims]).alias("features"))
        scores, _, _ = pca(part, min(k, len(dims)), [gene])
        one = cohesion(scores, sets, gene).agg(F.avg("cohesion").alias("mean_cohesion"), F.stddev_samp("cohesion").alias("std_cohesion")).withColumn("organelle", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def feature_smoothness(points: DataFrame, long: DataFrame, k: int = 30, n: int | None = None) -> DataFrame:
    """|Spearman| of each feature with its mean over the k nearest points of the embedding, and the
    mean of scaled variance and scaled smoothness. ``long`` is (id, feature, value)."""
    nn = checkpointed(PR.nearest(points, points, k).select("id", "ref_id"))
    around = nn.join(long.select(F.col("id").alias("ref_id"), "feature", "value"), "ref_id").groupBy("id", "feature").agg(F.avg("value").alias("around"))
    j = long.where(F.col("value").isNotNull()).join(around.where(F.col("around").isNotNull()), ["id", "feature"])
    j = j.withColumn("around", F.round("around", 12))
    ranked = average_rank(average_rank(checkpointed(j), ["feature"], "value", "ra"), ["feature"], "around", "rb")
    s = ranked.groupBy("feature").agg(F.coalesce(F.abs(F.corr("ra", "rb")), F.lit(0.0)).alias("smoothness"))
    v = long.groupBy("feature").agg(F.var_samp("value").alias("variance"))
    both = min_max_composite(s.join(v, "feature"), "feature", ["variance", "smoothness"], "score")
    out = both.select("feature", "variance", "smoothness", "score").orderBy(F.col("score").desc(), "feature")
    return out.limit(n) if n else out
