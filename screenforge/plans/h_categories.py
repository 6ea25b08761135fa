"""Gene sets, categories, enrichment and comparison tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.functions.scalars import is_control_by_name
from screenforge.operators import categories as K
from screenforge.operators import cluster as C
from screenforge.operators import graph as G
from screenforge.operators import joins as J
from screenforge.operators import records as RC
from screenforge.operators import stats as R
from screenforge.operators import summaries as S
from screenforge.operators import windows as W
from screenforge.plans import tables as T
from screenforge.plans.c_joins import _CAT_SQL, mapping
from screenforge.plans.d_stats import EFFECTS, LONG, _SETS, effects, long
from screenforge.plans.registry import query
from screenforge.sources import io as IO

KEYWORDS = {"alpha": ["the", "there", "and"], "beta": ["eau", "oi", "tion"], "gamma": ["und", "sch", "ein"], "delta": ["los", "que", "ar"]}
# hypergeometric tail in SQL: n_in of n_cluster drawn, n_gene marked among n_all
HYPER = """(SELECT sum(exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + lgamma({M} - {n} + 1) - lgamma({N} - k + 1) - lgamma({M} - {n} - {N} + k + 1) - lgamma({M} + 1) + lgamma({N} + 1) + lgamma({M} - {N} + 1)))
 FROM (SELECT unnest(range(CAST(greatest({k}, {N} + {n} - {M}) AS BIGINT), CAST(least({n}, {N}) AS BIGINT) + 1)) AS k))"""


@query("f9_keyword_category", "WITH s AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) + f") AS {c}" for c, ws in KEYWORDS.items()) + """ FROM documents), l AS (SELECT doc_id, 'alpha' AS category, alpha AS hits FROM s UNION ALL SELECT doc_id, 'beta', beta FROM s UNION ALL SELECT doc_id, 'gamma', gamma FROM s UNION ALL SELECT doc_id, 'delta', delta FROM s)
SELECT doc_id, CASE WHEN hits > 0 THEN category END AS category, hits FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, category) = 1""")
def f9(spark, sf):
    return K.best_keyword_category(T.read(spark, sf, "documents").select("doc_id", "text"), "text", KEYWORDS).drop("text")


@query("f10_regex_category", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^red|^blue') THEN 'colour' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' END AS category FROM part""")
def f10(spark, sf):
    return T.read(spark, sf, "part").select("p_partkey", K.regex_category(F.col("p_name"), {"colour": ["^red", "^blue"], "ring": ["ring$"]}).alias("category"))


_THEME = {"Ring": ["RING"], "Red": ["RED"], "Widget": ["WIDGET", "GADGET"], "Small": ["SMALL"]}


@query("f11_cluster_theme", "WITH g AS (SELECT p_brand, count(*) AS n_genes, " + ", ".join(f"count(*) FILTER ({' OR '.join(f'contains(upper(p_name), {chr(39)}{w}{chr(39)})' for w in ws)}) AS {c}" for c, ws in _THEME.items()) + """ FROM part GROUP BY 1),
l AS (SELECT p_brand, n_genes, unnest([{'k': Ring, 'i': 0, 'c': 'Ring'}, {'k': Red, 'i': 1, 'c': 'Red'}, {'k': Widget, 'i': 2, 'c': 'Widget'}, {'k': Small, 'i': 3, 'c': 'Small'}]) AS s FROM g), r AS (SELECT p_brand, n_genes, s.k AS k, s.c AS c, row_number() OVER (PARTITION BY p_brand ORDER BY s.k DESC, s.i) AS rn FROM l WHERE s.k > 0),
t AS (SELECT g.p_brand, g.n_genes, a.k, a.c AS c1, b.c AS c2 FROM g LEFT JOIN r a ON a.p_brand = g.p_brand AND a.rn = 1 LEFT JOIN r b ON b.p_brand = g.p_brand AND b.rn = 2)
SELECT p_brand, n_genes, CASE WHEN c1 IS NULL THEN 'Uncharacterized' WHEN k * 100.0 / n_genes >= 30 THEN c1 WHEN k * 100.0 / n_genes >= 15 THEN c1 || '?' WHEN c2 IS NOT NULL THEN c1 || '/' || c2 ELSE 'Mixed' END AS theme FROM t""")
def f11(spark, sf):
    return K.cluster_theme(T.read(spark, sf, "part"), "p_brand", "p_name", _THEME)


# --- enrichment -------------------------------------------------------------------------------
ENR = f"""{T.GENE_CELLS}, pr AS (SELECT well AS cluster, gene, count(*) AS n_in FROM gene_cells GROUP BY 1, 2), en AS (SELECT cluster, gene, n_in, CAST(sum(n_in) OVER (PARTITION BY cluster) AS BIGINT) AS n_cluster, CAST(sum(n_in) OVER (PARTITION BY gene) AS BIGINT) AS n_gene, CAST(sum(n_in) OVER () AS BIGINT) AS n_all FROM pr),
ep AS (SELECT *, CAST(n_in AS DOUBLE) * (n_all - n_cluster - n_gene + n_in) / ((n_cluster - n_in) * (n_gene - n_in)) AS odds_ratio, {HYPER.format(k="n_in", n="n_gene", M="n_all", N="n_cluster")} AS p FROM en WHERE n_in >= 2)"""


def enrichment(spark, sf):
    return K.cluster_enrichment(T.gene_cells(spark, sf).select(F.col("well").alias("cluster"), "gene"))


@query("r14_cluster_enrichment", f"""WITH {ENR}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p) AS i, count(*) OVER (PARTITION BY cluster) AS m FROM ep)
SELECT cluster, gene, n_in, n_cluster, n_gene, odds_ratio, p, least(1, min(p * m / i) OVER (PARTITION BY cluster ORDER BY i DESC)) AS p_adj FROM rk""", doubles="odds_ratio p p_adj")
def r14(spark, sf):
    return enrichment(spark, sf)


@query("a36_annotation_text", f"""WITH {ENR}, t AS (SELECT cluster, gene, odds_ratio, row_number() OVER (PARTITION BY cluster ORDER BY odds_ratio DESC, gene) AS r FROM ep)
SELECT cluster, string_agg(gene || ' (' || format('{{:.1f}}', odds_ratio) || '×)', ', ' ORDER BY r) AS annotation FROM t WHERE r <= 5 GROUP BY 1""")
def a36(spark, sf):
    return K.annotation_text(enrichment(spark, sf))


_LISTS = f"""{T.GENE_CELLS}, {T.GENES}, z AS (SELECT guide, gene, well AS feature, avg(cell_area) - 250000 AS fc FROM gene_cells GROUP BY 1, 2, 3), u AS (SELECT *, 'up' AS direction, row_number() OVER (PARTITION BY feature ORDER BY fc DESC, guide) AS r FROM z WHERE fc > 0 UNION ALL
 SELECT *, 'down', row_number() OVER (PARTITION BY feature ORDER BY fc, guide) FROM z WHERE fc < 0), li AS (SELECT * FROM u WHERE r <= 20), gs AS (SELECT c_custkey AS guide, 'n' || c_nationkey AS set_id FROM customer), bg AS (SELECT DISTINCT guide FROM gene_cells),
gb AS (SELECT * FROM gs WHERE guide IN (SELECT guide FROM bg)), h AS (SELECT feature, direction, set_id, count(*) AS overlap, string_agg(CAST(guide AS VARCHAR), ',' ORDER BY CAST(guide AS VARCHAR)) AS genes FROM li JOIN gb USING (guide) GROUP BY 1, 2, 3),
q AS (SELECT h.*, l.n_list, s.n_set, (SELECT count(*) FROM bg) AS n_all FROM h JOIN (SELECT feature, direction, count(*) AS n_list FROM li GROUP BY 1, 2) l USING (feature, direction) JOIN (SELECT set_id, count(*) AS n_set FROM gb GROUP BY 1) s USING (set_id)),
hp AS (SELECT *, {HYPER.format(k="overlap", n="n_set", M="n_all", N="n_list")} AS p FROM q)"""


def terms(spark, sf, top=3):
    c = T.gene_cells(spark, sf)
    z = c.groupBy("guide", F.col("well").alias("feature")).agg((F.avg("cell_area") - 250000).alias("fc"))
    lists = RC.up_down_lists(z, ["feature"], "fc", "guide", 20).select("feature", "direction", F.col("guide").cast("string").alias("gene"))
    sets = T.guides(spark, sf).select(F.col("guide").cast("string").alias("gene"), F.concat(F.lit("n"), "gene").alias("set_id"))
    return K.over_representation(lists, sets, c.select(F.col("guide").cast("string").alias("gene")), ["feature", "direction"], top=top)


@query("r15_over_representation", f"""WITH {_LISTS} SELECT feature, direction, set_id, overlap, genes, n_list, n_set, p FROM hp QUALIFY row_number() OVER (PARTITION BY feature, direction ORDER BY round(p, 12), overlap DESC, set_id) <= 3""", doubles="p")
def r15(spark, sf):
    return terms(spark, sf).select("feature", "direction", "set_id", "overlap", "genes", "n_list", "n_set", "p")


@query("r27_term_matrix", f"""WITH {_LISTS}, t AS (SELECT * FROM hp WHERE direction = 'up' QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(p, 12), overlap DESC, set_id) <= 3) SELECT set_id, max(-log10(p)) FILTER (feature = '1-URGENT') AS "1-URGENT", max(-log10(p)) FILTER (feature = '5-LOW') AS "5-LOW" FROM t GROUP BY 1""", doubles='"1-URGENT" "5-LOW"')
def r27(spark, sf):
    return K.term_matrix(terms(spark, sf), "up", ["1-URGENT", "5-LOW"])


@query("r26_set_volcano", f"""WITH {LONG}, {_SETS}, {EFFECTS}, top AS (SELECT set_id, feature FROM effects QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY abs(d) DESC, feature) <= 3), c AS (SELECT feature, avg(value) AS cm FROM l WHERE gene = '0' GROUP BY 1),
g AS (SELECT gene, feature, avg(value) AS mean, count(value) AS n FROM l WHERE gene <> '0' AND feature IN (SELECT feature FROM top) GROUP BY 1, 2 HAVING count(value) >= 2)
SELECT t.set_id, g.gene, g.feature, mean, log2((mean + 1e-10) / (cm + 1e-10)) AS log2_fc, g.gene IN (SELECT gene FROM sets x WHERE x.set_id = t.set_id) AS member FROM g JOIN c USING (feature) JOIN top t USING (feature)""", doubles="mean log2_fc", digits=4)
def r26(spark, sf):
    l = long(spark, sf)
    from screenforge.operators.skew import top_n

    top = top_n(effects(spark, sf), ["set_id"], [F.abs("d").desc(), F.col("feature")], 3).select("set_id", "feature")
    v = R.gene_feature_volcano(l.join(top.select("feature").distinct(), "feature", "left_semi"), is_control_by_name(F.col("gene")), with_p=False)
    members = T.genes(spark, sf).select("gene", "set_id", F.lit(True).alias("m"))
    j = v.join(top, "feature").join(members, ["gene", "set_id"], "left")
    return j.select("set_id", "gene", "feature", "mean", "log2_fc", F.coalesce("m", F.lit(False)).alias("member"))


# --- categories -------------------------------------------------------------------------------
SCORES = f"""{T.GENE_CELLS}, sc AS (SELECT gene, batch AS reporter, avg(cell_area) / 500000 AS mean_average_precision, avg(cell_area) > 250000 AS below_corrected_p FROM gene_cells GROUP BY 1, 2)"""


def scores(spark, sf):
    return T.gene_cells(spark, sf).groupBy("gene", F.col("batch").alias("reporter")).agg(
        (F.avg("cell_area") / 500000).alias("mean_average_precision"), (F.avg("cell_area") > 250000).alias("below_corrected_p"))


@query("a11_mean_profiles", f"""WITH {T.PROFILES} SELECT perturbation, CAST(i - 1 AS INTEGER) AS dim, avg(features[i]) AS value FROM profiles, range(1, 65) t(i) GROUP BY 1, 2""", doubles="value", digits=8)
def a11(spark, sf):
    return C.centroid_vectors(T.profiles(spark, sf), "perturbation").select(F.col("id").alias("perturbation"), F.posexplode("features").alias("dim", "value"))


@query("a22_supercategory_scores", f"""WITH {SCORES}, {T.GENES}, x AS (SELECT set_id, reporter, mean_average_precision, mean_average_precision / 2 AS p_value, below_corrected_p FROM sc JOIN genes USING (gene))
SELECT 'set' || set_id AS category, avg(mean_average_precision) AS mean_map, avg(p_value) AS mean_p, bool_or(below_corrected_p) AS any_significant, count(*) AS n_clusters FROM x GROUP BY 1""", doubles="mean_map mean_p")
def a22(spark, sf):
    s = scores(spark, sf).select(F.col("gene").alias("cluster"), "mean_average_precision", (F.col("mean_average_precision") / 2).alias("p_value"), F.col("below_corrected_p").alias("significant"))
    return S.supercategory_scores(s, T.genes(spark, sf).select(F.col("gene").alias("cluster"), F.concat(F.lit("set"), "set_id").alias("category")))


@query("a23_method_means", f"WITH {SCORES} SELECT reporter, avg(mean_average_precision) AS mean_map, avg(CASE WHEN below_corrected_p THEN 1.0 ELSE 0 END) AS ratio FROM sc GROUP BY 1", doubles="mean_map ratio")
def a23(spark, sf):
    return scores(spark, sf).groupBy("reporter").agg(F.avg("mean_average_precision").alias("mean_map"), F.avg(F.col("below_corrected_p").cast("double")).alias("ratio"))


@query("a25_category_coverage", f"WITH {_CAT_SQL} SELECT category, count(DISTINCT gene) AS n_genes, count(DISTINCT gene) / (SELECT count(DISTINCT gene) FROM genes) AS share FROM mapping GROUP BY 1", doubles="share")
def a25(spark, sf):
    return S.category_coverage(mapping(spark, sf), T.genes(spark, sf))


@query("a25_categories_per_gene", f"WITH {_CAT_SQL}, p AS (SELECT gene, count(DISTINCT category) AS c FROM mapping GROUP BY 1) SELECT avg(c) AS mean_categories, max(c) AS max_categories, count(*) AS n_genes FROM p", doubles="mean_categories")
def a25g(spark, sf):
    return S.categories_per_gene(mapping(spark, sf))


@query("a28_feature_summary", """WITH t AS (SELECT DISTINCT p_brand AS organelle, p_type AS category, p_name AS feature FROM part) SELECT organelle, category, count(*) AS n_features FROM t GROUP BY 1, 2""")
def a28(spark, sf):
    t = T.read(spark, sf, "part").select(F.col("p_brand").alias("organelle"), F.col("p_type").alias("category"), F.col("p_name").alias("feature")).distinct()
    return t.groupBy("organelle", "category").agg(F.count(F.lit(1)).alias("n_features"))


@query("a34_reporter_summary", f"WITH {SCORES} SELECT reporter, count(*) AS n, avg(CASE WHEN below_corrected_p THEN 1.0 ELSE 0 END) AS ratio, avg(mean_average_precision) AS mean_map FROM sc GROUP BY 1", doubles="ratio mean_map")
def a34(spark, sf):
    return K.reporter_summary(scores(spark, sf))


@query("a35_cluster_gene_lists", f"WITH {T.GENE_CELLS} SELECT well AS cluster, count(DISTINCT gene) AS n_genes, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM gene_cells GROUP BY 1")
def a35(spark, sf):
    return K.cluster_gene_lists(T.gene_cells(spark, sf).select(F.col("well").alias("cluster"), "gene"))


@query("j5_compare_methods", f"WITH {SCORES} SELECT a.gene, a.mean_average_precision AS mean_average_precision_a, b.mean_average_precision AS mean_average_precision_b FROM sc a JOIN sc b USING (gene) WHERE a.reporter = 'FURNITURE' AND b.reporter = 'BUILDING'", doubles="mean_average_precision_a mean_average_precision_b")
def j5(spark, sf):
    one = lambda r: scores(spark, sf).where(F.col("reporter") == r).select("gene", "mean_average_precision")
    return J.compare_methods(one("FURNITURE"), one("BUILDING"), ["gene"])


@query("j6_real_and_control", f"""WITH {SCORES}, c AS (SELECT gene, min(mean_average_precision) AS control FROM sc WHERE reporter = 'BUILDING' AND below_corrected_p GROUP BY 1) SELECT gene, mean_average_precision AS real, control FROM sc JOIN c USING (gene) WHERE reporter = 'FURNITURE'""", doubles="real control")
def j6(spark, sf):
    s = scores(spark, sf)
    c = s.where("reporter = 'BUILDING' AND below_corrected_p").groupBy("gene").agg(F.min("mean_average_precision").alias("control"))
    return s.where("reporter = 'FURNITURE'").select("gene", F.col("mean_average_precision").alias("real")).join(c, "gene")


RADAR = """j AS (SELECT reporter, category, avg({v}) AS v, count(*) AS n_genes FROM sc JOIN mapping USING (gene) WHERE category <> 'Other' GROUP BY 1, 2), rd AS (SELECT reporter, category, CASE WHEN n_genes >= 3 THEN v ELSE 0 END AS score, n_genes FROM j),
radar AS (SELECT * FROM rd WHERE category IN (SELECT category FROM rd GROUP BY 1 HAVING max(abs(score)) > 0))"""
_RSQL = f"{SCORES}, {_CAT_SQL}"


@query("q17_radar_matrix", f"WITH {_RSQL}, {RADAR.format(v='mean_average_precision')} SELECT * FROM radar", doubles="score")
def q17(spark, sf):
    return K.radar_matrix(scores(spark, sf), mapping(spark, sf))


@query("q17_radar_fraction", f"WITH {_RSQL}, {RADAR.format(v='CASE WHEN below_corrected_p THEN 1.0 ELSE 0 END')} SELECT * FROM radar", doubles="score")
def q17f(spark, sf):
    return K.radar_matrix(scores(spark, sf), mapping(spark, sf), "below_corrected_p")


@query("q18_normalised_radar", f"WITH {_RSQL}, {RADAR.format(v='mean_average_precision')} SELECT r.category, r.reporter, r.score, r.n_genes, r.score / CASE WHEN b.score = 0 THEN 1e-6 ELSE b.score END AS normalised FROM radar r LEFT JOIN radar b ON b.category = r.category AND b.reporter = 'HOUSEHOLD'", doubles="score normalised")
def q18(spark, sf):
    return W.normalise_to_baseline(K.radar_matrix(scores(spark, sf), mapping(spark, sf)), ["category"], "reporter", "HOUSEHOLD", "score", 1e-6)


@query("q19_q26_filtered_matrix", f"WITH {SCORES}, b AS (SELECT gene, mean_average_precision AS b FROM sc WHERE reporter = 'HOUSEHOLD' AND mean_average_precision >= 0.5) SELECT gene, reporter, mean_average_precision AS score, least(mean_average_precision / b, 1) AS normalised FROM sc JOIN b USING (gene)", doubles="score normalised")
def q19(spark, sf):
    s = scores(spark, sf).select("gene", "reporter", F.col("mean_average_precision").alias("score"))
    return K.filtered_matrix(s, "HOUSEHOLD", 0.5)


@query("q20_category_strip", f"""WITH {SCORES}, {T.GENES}, s AS (SELECT gene, reporter, mean_average_precision AS score FROM sc WHERE gene IN (SELECT gene FROM genes WHERE set_id = 1)),
r AS (SELECT *, avg(score) OVER (PARTITION BY reporter) AS reporter_mean, row_number() OVER (PARTITION BY reporter ORDER BY score DESC, gene) AS hi, row_number() OVER (PARTITION BY reporter ORDER BY score, gene) AS lo FROM s)
SELECT gene, reporter, score, reporter_mean, CASE WHEN hi <= 2 THEN 'top' WHEN lo <= 2 THEN 'bottom' END AS label FROM r""", doubles="score reporter_mean")
def q20(spark, sf):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    m = scores(spark, sf).groupBy("gene").pivot("reporter", segments).agg(F.first("mean_average_precision"))
    return K.category_strip(m, segments, mapping(spark, sf), "set1", 2)


@query("q21_category_assignment", f"""WITH {T.GENES}, p1 AS (SELECT gene, 'c' || set_id AS category, 1 AS pass FROM genes WHERE set_id = 0), tx AS (SELECT CAST(doc_id % 25 AS VARCHAR) AS gene, text FROM documents),
p2 AS (SELECT DISTINCT gene, 'english' AS category, 2 AS pass FROM tx WHERE contains(lower(text), 'en')), p3 AS (SELECT gene, 'teens', 3 FROM genes WHERE regexp_matches(gene_name, '_1[0-9]$')), p4 AS (SELECT gene, 'late', 4 FROM genes WHERE set_id = 4),
u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) SELECT gene, category, pass FROM u QUALIFY row_number() OVER (PARTITION BY gene ORDER BY pass, category) = 1""")
def q21(spark, sf):
    g = T.genes(spark, sf)
    text = T.read(spark, sf, "documents").select((F.col("doc_id") % 25).cast("string").alias("gene"), "text")
    return K.assign_categories(g, g.where("set_id = 0").select("gene", F.concat(F.lit("c"), "set_id").alias("category")), text, {"english": ["en"]}, {"teens": ["_1[0-9]$"]}, g.where("set_id = 4").select("gene", F.lit("late").alias("category")))


@query("q22_recursive_members", """WITH RECURSIVE l AS (SELECT n_nationkey AS cluster, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent FROM nation), a AS (SELECT cluster AS anc, cluster AS node FROM l UNION ALL SELECT a.anc, l.cluster FROM a JOIN l ON l.parent = a.node)
SELECT DISTINCT a.anc AS cluster, c_custkey AS gene FROM a JOIN customer ON c_nationkey = a.node""")
def q22(spark, sf):
    n = F.col("n_nationkey")
    links = T.read(spark, sf, "nation").select(n.alias("cluster"), F.when(n > 0, F.floor((n - 1) / 2).cast("int")).alias("parent"))
    return G.recursive_members(links, T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("gene")))


@query("q10_method_comparison", f"""WITH {SCORES}, a AS (SELECT * FROM sc WHERE reporter = 'FURNITURE'), b AS (SELECT * FROM sc WHERE reporter = 'BUILDING') SELECT CASE WHEN coalesce(a.below_corrected_p, false) AND coalesce(b.below_corrected_p, false) THEN 'both' WHEN coalesce(a.below_corrected_p, false) THEN 'a_only' WHEN coalesce(b.below_corrected_p, false) THEN 'b_only' ELSE 'neither' END AS overlap,
 count(*) AS n, avg(a.mean_average_precision) AS mean_a, avg(b.mean_average_precision) AS mean_b FROM a FULL JOIN b USING (gene) GROUP BY 1""", doubles="mean_a mean_b")
def q10(spark, sf):
    s = scores(spark, sf)
    a, b = s.where("reporter = 'FURNITURE'"), s.where("reporter = 'BUILDING'")
    o = RC.overlap_classes(a, b, ["gene"], "below_corrected_p")
    m = lambda df, n: df.select("gene", F.col("mean_average_precision").alias(n))
    return o.join(m(a, "x"), "gene", "left").join(m(b, "y"), "gene", "left").groupBy("overlap").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"))


@query("k14_representative_rows", f"""WITH {T.GENE_CELLS}, i AS (SELECT batch, guide, row_number() OVER (PARTITION BY batch ORDER BY avg(cell_area) DESC, guide) AS rank FROM gene_cells GROUP BY 1, 2 QUALIFY rank <= 3), r AS (SELECT i.batch, i.guide, g.cell_id, g.cell_area AS score, rank AS item_rank FROM gene_cells g JOIN i USING (batch, guide)),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY item_rank, batch, guide) = 1) SELECT batch, guide, cell_id, score, item_rank, row_number() OVER (PARTITION BY batch, guide ORDER BY score DESC, cell_id) AS row_rank FROM o QUALIFY row_rank <= 2""", doubles="score")
def k14(spark, sf):
    from screenforge.operators.skew import top_n

    c = T.gene_cells(spark, sf)
    items = top_n(c.groupBy("batch", "guide").agg(F.avg("cell_area").alias("m")), ["batch"], [F.col("m").desc(), F.col("guide")], 3)
    rows = c.select("batch", "guide", "cell_id", F.col("cell_area").alias("score"))
    out = K.representative_rows(items, rows, "batch", "guide", "cell_id", 2)
    return out.select("batch", "guide", "cell_id", "score", F.col("item_rank").cast("long"), F.col("row_rank").cast("long"))


@query("q24_corrected_summary", f"""WITH {SCORES}, p AS (SELECT gene, max(mean_average_precision) FILTER (reporter = 'FURNITURE') AS a, max(mean_average_precision) FILTER (reporter = 'BUILDING') AS b FROM sc GROUP BY 1), c AS (SELECT gene, max(mean_average_precision) FILTER (reporter = 'HOUSEHOLD') AS a, max(mean_average_precision) FILTER (reporter = 'MACHINERY') AS b FROM sc GROUP BY 1),
j AS (SELECT p.*, greatest(c.a, 0.005) AS ca, greatest(c.b, 0.005) AS cb FROM p JOIN c USING (gene)) SELECT gene, a, b, sqrt(ca * cb) AS geo, a * least(greatest(sqrt(ca * cb) / ca, 0.2), 5) AS a_corrected, b * least(greatest(sqrt(ca * cb) / cb, 0.2), 5) AS b_corrected FROM j""", doubles="a b geo a_corrected b_corrected")
def q24(spark, sf):
    s = scores(spark, sf)
    pick = lambda x, y: s.groupBy("gene").agg(F.max(F.when(F.col("reporter") == x, F.col("mean_average_precision"))).alias("a"), F.max(F.when(F.col("reporter") == y, F.col("mean_average_precision"))).alias("b"))
    real = IO.collect_summaries([pick("FURNITURE", "BUILDING")], "gene", F.col("a"))
    return R.geometric_batch_correction(real, pick("HOUSEHOLD", "MACHINERY"), "gene", ("a", "b"))


def _head_to_head(control):
    """Two feature halves of the same profiles: common labels, equal sizes, normalised, activity on each side."""
    def q(spark, sf):
        from screenforge.operators import retrieval as Q
        from screenforge.operators.longform import array_to_long, to_vector

        p = T.profiles(spark, sf)
        eq = RC.equalise(p, "perturbation", "id")
        long_ = array_to_long(eq, ["id", "perturbation"], "features").withColumnRenamed("dim", "feature")
        z = R.normalise(long_, F.col("perturbation") == "0")
        rows = to_vector(z.withColumn("value", F.coalesce("z", F.lit(0.0))), ["id", "perturbation"])
        sides = {"cp": range(32), "live": range(32, 64)} if not control else {"cp": range(16), "live": range(16)}
        m = Q.mean_average_precision(Q.activity(rows, F.col("perturbation") == "0", sides))
        w = m.groupBy("label").agg(*[F.max(F.when(F.col("variant") == s, F.col("mean_average_precision"))).alias(s) for s in sides])
        return R.winner(w, "cp", "live").drop(*(["winner"] if control else []))

    return q


_H2H = """WITH {p}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM profiles GROUP BY perturbation)), eq AS (SELECT * FROM profiles QUALIFY row_number() OVER (PARTITION BY perturbation ORDER BY CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 15) AS BIGINT)) <= (SELECT n FROM n)),
u AS (SELECT id, perturbation, i, features[i] AS v FROM eq, range(1, 65) t(i)), st AS (SELECT i, avg(v) AS mu, stddev_samp(v) AS sd FROM u WHERE perturbation = '0' GROUP BY 1), zz AS (SELECT id, perturbation, list(coalesce((v - mu) / nullif(sd, 0), 0) ORDER BY i) AS f FROM u JOIN st USING (i) GROUP BY 1, 2), {sides}
SELECT label, cp, live, cp - live AS delta, CASE WHEN cp > live THEN 'cp' ELSE 'live' END AS winner FROM cp JOIN live USING (label)"""


def _side(name, lo, hi):
    return f"""s_{name} AS (SELECT q.id, q.perturbation AS label, q.perturbation = r.perturbation AS pos, CAST(round(list_cosine_similarity(q.f[{lo}:{hi}], r.f[{lo}:{hi}]) * 1000000) AS BIGINT) AS sim FROM zz q JOIN zz r ON q.id <> r.id WHERE q.perturbation <> '0' AND (q.perturbation = r.perturbation OR r.perturbation = '0')),
k_{name} AS (SELECT id, label, pos, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pos) AS rank, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY sim DESC, pos ROWS UNBOUNDED PRECEDING) AS npos FROM s_{name}), ap_{name} AS (SELECT id, label, avg(npos / rank) FILTER (pos) AS ap FROM k_{name} GROUP BY 1, 2),
{name} AS (SELECT label, avg(ap) AS {name} FROM ap_{name} GROUP BY 1)"""


query("q9_head_to_head", _H2H.format(p=T.PROFILES, sides=_side("cp", 1, 32) + ", " + _side("live", 33, 64)), doubles="cp live delta")(_head_to_head(False))
# both sides see the same features here, so the difference is 0 and there is no winner
query("q23_control_comparison", "SELECT * EXCLUDE (winner) FROM (" + _H2H.format(p=T.PROFILES, sides=_side("cp", 1, 16) + ", " + _side("live", 1, 16)) + ")", doubles="cp live delta")(_head_to_head(True))
