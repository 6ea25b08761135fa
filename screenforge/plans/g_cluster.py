"""Embedding, neighbours and clustering, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.operators import cluster as C
from screenforge.operators import pairs as PR
from screenforge.operators.longform import array_to_long
from screenforge.plans import tables as T
from screenforge.plans.f_retrieval import REPORTERS
from screenforge.plans.registry import query
from screenforge.session import stored

P = T.PROFILES
PD = f"{P}, d AS (SELECT a.id, a.perturbation AS ga, b.id AS other, b.perturbation AS gb, list_distance(a.features, b.features) AS dist FROM profiles a JOIN profiles b ON a.id <> b.id)"


def prof(spark, sf):
    return T.profiles(spark, sf)


@query("m1_pca_variance")
def m1(spark, sf):
    return C.pca(prof(spark, sf), 20)[1]


@query("m1_pca_scores")
def m1s(spark, sf):
    return C.pca(prof(spark, sf), 10)[0].select("id", F.transform("features", lambda v: F.round(v, 6)).alias("features"))


@query("m1_pca_summary")
def m1v(spark, sf):
    return C.variance_summary(C.pca(prof(spark, sf), 64)[1])


@query("m2_pca_to_threshold")
def m2(spark, sf):
    p = prof(spark, sf)
    genes = C.centroid_vectors(p, "perturbation")
    _, g, k = C.pca_to_threshold(p.select("id", "features"), genes, 64, 0.95)
    return g.select("id", F.lit(k).alias("k"), F.size("features").alias("n_components"))


@query("m3_effective_dimension")
def m3(spark, sf):
    return C.effective_dimension(prof(spark, sf), {"a": range(32), "b": range(32, 64)})


@query("m4_cross_redundancy")
def m4(spark, sf):
    return C.cross_redundancy(prof(spark, sf), range(32), range(32, 64))


@query("m5_group_embeddings")
def m5(spark, sf):
    e = C.group_embeddings(prof(spark, sf), REPORTERS, 5)
    return e.select("organelle", "id", F.transform("features", lambda v: F.round(v, 6)).alias("features"))


@query("m6_kmeans_elbow")
def m6(spark, sf):
    return C.kmeans_elbow(prof(spark, sf), 2, 12)[1]


@query("m7_kmeans_by_silhouette")
def m7(spark, sf):
    return C.kmeans_by_silhouette(prof(spark, sf), [5, 8, 10])[1]


@query("m8_density_clusters", f"""WITH RECURSIVE {PD}, n AS (SELECT id, count(*) + 1 AS n FROM d WHERE dist <= {{eps}} GROUP BY 1), core AS (SELECT id FROM n WHERE n >= 5), e AS (SELECT id, other FROM d WHERE dist <= {{eps}} AND id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
r AS (SELECT id, id AS root FROM core UNION SELECT e.other, r.root FROM r JOIN e ON e.id = r.id), c AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1),
b AS (SELECT d.id, arg_min(c.cluster, (dist, d.other)) AS cluster FROM d JOIN c ON c.id = d.other WHERE dist <= {{eps}} AND d.id NOT IN (SELECT id FROM core) GROUP BY 1), l AS (SELECT * FROM c UNION ALL SELECT * FROM b),
k AS (SELECT cluster FROM l GROUP BY 1 HAVING count(*) >= 25) SELECT p.id, l.cluster FROM profiles p LEFT JOIN (SELECT * FROM l WHERE cluster IN (SELECT cluster FROM k)) l USING (id)""".format(eps=0.9))
def m8(spark, sf):
    return C.density_clusters(prof(spark, sf), 0.9, 5, 25)


@query("m8_density_hierarchy")
def m8h(spark, sf):
    return C.density_hierarchy(prof(spark, sf))


@query("m9_communities")
def m9(spark, sf):
    e = stored(C.knn_graph(prof(spark, sf), 10))
    return C.modularity(e, C.communities(e))


@query("m10_label_propagation", f"""WITH {P}, s AS (SELECT * FROM profiles WHERE id % 5 = 0), n AS (SELECT a.id, s.perturbation, list_distance(a.features, s.features) AS distance, s.id AS sid FROM profiles a JOIN s ON a.id % 5 <> 0)
SELECT id, perturbation, distance FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, sid) = 1""", doubles="distance")
def m10(spark, sf):
    p = prof(spark, sf)
    return C.propagate_labels(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), "perturbation")


@query("m11_subclusters")
def m11(spark, sf):
    found = C.ward_subclusters(prof(spark, sf).withColumn("cluster", F.col("perturbation").cast("int")))
    return found.where("cluster IS NOT NULL").groupBy("cluster", "subcluster").agg(F.count(F.lit(1)).alias("n"))


SIL = f"""{PD}, g AS (SELECT id, ga, gb, avg(dist) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT id, ga, max(m) FILTER (ga = gb) AS a, min(m) FILTER (ga <> gb) AS b FROM g GROUP BY 1, 2)"""


@query("m12_cluster_silhouette", f"WITH {SIL} SELECT ga AS perturbation, count(*) AS n, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM s GROUP BY 1", doubles="silhouette")
def m12(spark, sf):
    return C.cluster_sizes_and_silhouette(prof(spark, sf), "perturbation")


def _m13(lo, hi):
    return f"""(SELECT ga, avg((b - a) / greatest(a, b)) AS s FROM (SELECT a.id, a.perturbation AS ga, avg(list_distance(a.features[{lo}:{hi}], b.features[{lo}:{hi}])) FILTER (a.perturbation = b.perturbation) AS a,
 avg(list_distance(a.features[{lo}:{hi}], b.features[{lo}:{hi}])) FILTER (a.perturbation <> b.perturbation) AS b FROM profiles a JOIN profiles b ON a.id <> b.id GROUP BY 1, 2) GROUP BY 1)"""


@query("m13_set_silhouettes", f"WITH {P} SELECT x.ga AS perturbation, x.s AS silhouette_a, y.s AS silhouette_b, x.s - y.s AS difference FROM {_m13(1, 32)} x JOIN {_m13(33, 64)} y USING (ga)", doubles="silhouette_a silhouette_b difference")
def m13(spark, sf):
    return C.set_silhouettes(prof(spark, sf), "perturbation", {"a": range(32), "b": range(32, 64)})


CENT = f"""{P}, u AS (SELECT id, perturbation, i, features[i] AS v FROM profiles, range(1, 65) t(i)), cm AS (SELECT perturbation, i, avg(v) AS v FROM u GROUP BY 1, 2), cent AS (SELECT perturbation, list(v ORDER BY i) AS c FROM cm GROUP BY 1)"""


@query("m14_centroid_distances", f"""WITH {CENT}, a AS (SELECT avg(list_distance(x.c, y.c)) AS inter FROM cent x JOIN cent y ON x.perturbation <> y.perturbation), b AS (SELECT avg(list_distance(features, c)) AS intra FROM profiles JOIN cent USING (perturbation))
SELECT inter, intra, inter / intra AS ratio FROM a, b""", doubles="inter intra ratio")
def m14(spark, sf):
    return C.centroid_distances(prof(spark, sf), "perturbation")


@query("m15_mutual_information", """WITH c AS (SELECT o_orderpriority AS a, c_mktsegment AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), j AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
s AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM j) SELECT mi, mi / ((ha + hb) / 2) AS nmi FROM s""", doubles="mi nmi", digits=9)
def m15(spark, sf):
    return C.mutual_information(T.gene_cells(spark, sf), "well", "batch")


@query("m16_knn_accuracy", f"""WITH {P}, f AS (SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 15) AS BIGINT) % 3 AS fold FROM profiles), n AS (SELECT a.id, a.fold, a.perturbation AS g, b.perturbation AS o FROM f a JOIN f b ON a.fold <> b.fold
 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.features, b.features), b.id) <= 5), v AS (SELECT id, fold, g, o, count(*) AS c FROM n GROUP BY 1, 2, 3, 4), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, o) = 1)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, avg(CASE WHEN g = o THEN 1.0 ELSE 0 END) AS accuracy FROM w GROUP BY 1""", doubles="accuracy")
def m16(spark, sf):
    return C.knn_accuracy(prof(spark, sf), "perturbation")


@query("m16_neighbour_purity", f"""WITH {PD}, n AS (SELECT id, min(dist) AS m FROM d GROUP BY 1) SELECT (SELECT avg(m) FROM n) AS nearest, avg(dist) AS all_pairs, greatest(0, 1 - (SELECT avg(m) FROM n) / avg(dist)) AS purity FROM d""", doubles="nearest all_pairs purity")
def m16p(spark, sf):
    return C.neighbour_purity(prof(spark, sf))


@query("m17_inter_group_distance", f"WITH {PD} SELECT avg(dist) FILTER (ga <> gb) AS mean_inter, max(dist) AS largest, avg(dist) FILTER (ga <> gb) / max(dist) AS score FROM d", doubles="mean_inter largest score")
def m17(spark, sf):
    return C.inter_group_distance(prof(spark, sf), "perturbation")


def _m18(i):
    lo, hi = 16 * i + 1, 16 * i + 16
    return f"""SELECT 'r{i}' AS organelle, (SELECT avg(list_distance(x.c[{lo}:{hi}], y.c[{lo}:{hi}])) FROM cent x JOIN cent y ON x.perturbation <> y.perturbation) / (SELECT avg(list_distance(features[{lo}:{hi}], c[{lo}:{hi}])) FROM profiles JOIN cent USING (perturbation)) AS ratio,
 (SELECT avg(t) FILTER (ga <> gb) / max(t) FROM e{i}) AS separation, (SELECT avg((b - a) / greatest(a, b)) FROM (SELECT id, max(m) FILTER (ga = gb) AS a, min(m) FILTER (ga <> gb) AS b FROM (SELECT id, ga, gb, avg(t) AS m FROM e{i} GROUP BY 1, 2, 3) GROUP BY 1)) AS silhouette"""


_M18 = CENT + ", " + ", ".join(f"e{i} AS (SELECT a.id, a.perturbation AS ga, b.perturbation AS gb, list_distance(a.features[{16 * i + 1}:{16 * i + 16}], b.features[{16 * i + 1}:{16 * i + 16}]) AS t FROM profiles a JOIN profiles b ON a.id <> b.id)" for i in range(2))
_SC = lambda m: f"({m} - min({m}) OVER ()) / nullif(max({m}) OVER () - min({m}) OVER (), 0)"


@query("m18_discrimination_ranking", f"""WITH {_M18}, o AS ({_m18(0)} UNION ALL {_m18(1)}), s AS (SELECT *, {_SC("ratio")} AS ratio_scaled, {_SC("separation")} AS separation_scaled, {_SC("silhouette")} AS silhouette_scaled FROM o) SELECT *, (ratio_scaled + separation_scaled + silhouette_scaled) / 3 AS composite FROM s""",
    doubles="ratio separation silhouette ratio_scaled separation_scaled silhouette_scaled composite")
def m18(spark, sf):
    return C.discrimination_ranking(prof(spark, sf), "perturbation", {"r0": range(16), "r1": range(16, 32)})


@query("m19_set_cohesion", f"""WITH {CENT}, {"sets AS (SELECT DISTINCT CAST(label AS VARCHAR) AS gene, CASE WHEN label < 3 THEN 0 ELSE 1 END AS set_id FROM embeddings)"}, m AS (SELECT set_id, perturbation, c FROM sets JOIN cent ON gene = perturbation),
i AS (SELECT a.set_id, avg(list_distance(a.c, b.c)) AS intra FROM m a JOIN m b ON a.set_id = b.set_id AND a.perturbation <> b.perturbation GROUP BY 1), n AS (SELECT set_id, count(*) AS n_genes FROM m GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 15) AS BIGINT)) AS rn FROM profiles), x AS (SELECT m.set_id, avg(list_distance(m.c, rk.features)) AS inter FROM m JOIN n USING (set_id) JOIN rk ON rn <= 10 * n_genes GROUP BY 1),
al AS (SELECT avg(list_distance(a.features, b.features)) AS all_pairs FROM profiles a JOIN profiles b ON a.id <> b.id)
SELECT CAST(set_id AS VARCHAR) AS set_id, n_genes, intra, all_pairs, least(greatest(1 - intra / all_pairs, 0), 1) AS cohesion, (inter - intra) / greatest(inter, intra) AS silhouette_like FROM i JOIN n USING (set_id) JOIN x USING (set_id), al""", doubles="intra all_pairs cohesion silhouette_like")
def m19(spark, sf):
    p = prof(spark, sf).withColumnRenamed("perturbation", "gene")
    sets = p.select("gene", F.when(F.col("gene").cast("int") < 3, 0).otherwise(1).alias("set_id")).distinct()
    return C.cohesion(p, sets)


@query("m20_cohesion_per_space")
def m20(spark, sf):
    p = prof(spark, sf).withColumnRenamed("perturbation", "gene")
    sets = p.select("gene", F.when(F.col("gene").cast("int") < 3, 0).otherwise(1).alias("set_id")).distinct()
    return C.cohesion_per_space(p, sets, {f"r{i}": range(16 * i, 16 * i + 16) for i in range(4)})


@query("m21_feature_smoothness", f"""WITH {P}, e AS (SELECT id, features[1:2] AS xy FROM profiles), nn AS (SELECT a.id, b.id AS o FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.xy, b.xy), b.id) <= 30),
l AS (SELECT id, 'f' || i AS feature, features[i] AS v FROM profiles, range(1, 9) t(i)), ar AS (SELECT nn.id, feature, round(avg(v), 12) AS a FROM nn JOIN l ON l.id = nn.o GROUP BY 1, 2),
r AS (SELECT l.feature, rank() OVER (PARTITION BY l.feature ORDER BY v) + (count(*) OVER (PARTITION BY l.feature, v) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY l.feature ORDER BY a) + (count(*) OVER (PARTITION BY l.feature, a) - 1) / 2.0::DOUBLE AS rb FROM l JOIN ar USING (id, feature)),
s AS (SELECT feature, abs(corr(ra, rb)) AS smoothness FROM r GROUP BY 1), w AS (SELECT feature, var_samp(v) AS variance FROM l GROUP BY 1), b AS (SELECT * FROM s JOIN w USING (feature))
SELECT feature, variance, smoothness, ({_SC("variance")} + {_SC("smoothness")}) / 2 AS score FROM b""", doubles="variance smoothness score")
def m21(spark, sf):
    p = prof(spark, sf)
    long = array_to_long(p, ["id"], "features").where("dim < 8").select("id", F.concat(F.lit("f"), F.col("dim") + 1).alias("feature"), "value")
    return C.feature_smoothness(p.select("id", F.slice("features", 1, 2).alias("features")), long)


@query("j10_pair_distance_sums", f"WITH {PD} SELECT id, gb AS ref_group, count(*) AS n, sum(dist) AS total, max(dist) AS largest FROM d GROUP BY 1, 2", doubles="total largest", digits=5)
def j10(spark, sf):
    return PR.group_distances(prof(spark, sf), prof(spark, sf), "perturbation")


@query("j13_nearest_neighbours", f"WITH {PD} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, other) AS INTEGER) AS rank, other AS ref_id, dist AS distance FROM d QUALIFY rank <= 10", doubles="distance")
def j13(spark, sf):
    return PR.nearest(prof(spark, sf), prof(spark, sf), 10)
