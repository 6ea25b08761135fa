"""Retrieval scores and attribution, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenforge.operators import attribution as AT
from screenforge.operators import retrieval as Q
from screenforge.plans import tables as T
from screenforge.plans.registry import query

REPORTERS = {f"r{i}": list(range(16 * i, 16 * i + 16)) for i in range(4)}


def control():
    return F.col("perturbation") == "0"


def ap_sql(qw, neg, sub="features", rw="true", tail=""):
    """Average precision CTEs: query filter, negative condition (q, r), vector expression."""
    return f"""{T.PROFILES}, pf AS (SELECT id, perturbation, {sub} AS v FROM profiles WHERE {rw}{tail}),
s AS (SELECT q.id, q.perturbation AS label, q.perturbation = r.perturbation AS pos, CAST(round(list_cosine_similarity(q.v, r.v) * 1000000) AS BIGINT) AS sim
 FROM pf q JOIN pf r ON q.id <> r.id WHERE {qw} AND (q.perturbation = r.perturbation OR {neg})),
k AS (SELECT id, label, pos, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pos) AS rank, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY sim DESC, pos ROWS UNBOUNDED PRECEDING) AS npos FROM s),
ap AS (SELECT id, label, avg(npos / rank) FILTER (pos) AS average_precision, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM k GROUP BY 1, 2 HAVING count(*) FILTER (pos) > 0)"""


ACT = ap_sql("q.perturbation <> '0'", "r.perturbation = '0'")
DIS = ap_sql("true", "true", rw="perturbation <> '0'")


@query("q1_q2_activity_average_precision", f"WITH {ACT} SELECT 'all' AS variant, * FROM ap", doubles="average_precision")
def q2(spark, sf):
    return Q.activity(T.profiles(spark, sf), control())


@query("q2_activity_map", f"WITH {ACT} SELECT 'all' AS variant, label, avg(average_precision) AS mean_average_precision, count(*) AS n_queries FROM ap GROUP BY label", doubles="mean_average_precision")
def q2m(spark, sf):
    return Q.mean_average_precision(Q.activity(T.profiles(spark, sf), control()))


@query("q3_distinctiveness_average_precision", f"WITH {DIS} SELECT 'all' AS variant, * FROM ap", doubles="average_precision")
def q3(spark, sf):
    return Q.distinctiveness(T.profiles(spark, sf), control())


@query("q3_distinctiveness_of_active", f"""WITH {ap_sql("true", "true", rw="perturbation IN ('1', '2', '3', '4')")} SELECT 'all' AS variant, label, avg(average_precision) AS mean_average_precision, count(*) AS n_queries FROM ap GROUP BY label""", doubles="mean_average_precision")
def q3a(spark, sf):
    active = T.profiles(spark, sf).where(F.col("perturbation").isin("1", "2", "3", "4")).select("perturbation")
    return Q.mean_average_precision(Q.distinctiveness(T.profiles(spark, sf), active=active))


SETS = """sets AS (SELECT DISTINCT vec_id AS gene, 's' || (label + k) % 7 AS set_id FROM embeddings, range(2) t(k) WHERE k = 0 OR label % 2 = 0)"""


def sets(spark, sf):
    p = T.profiles(spark, sf)
    lab = F.col("perturbation").cast("int")
    one = p.select(F.col("id").alias("gene"), F.concat(F.lit("s"), lab % 7).alias("set_id"))
    return one.union(p.where(lab % 2 == 0).select("id", F.concat(F.lit("s"), (lab + 1) % 7))).distinct()


CONS = f"""{T.PROFILES}, {SETS}, s AS (SELECT q.id, qs.set_id AS label, EXISTS (SELECT 1 FROM sets x WHERE x.gene = r.id AND x.set_id = qs.set_id) AS pos, CAST(round(list_cosine_similarity(q.features, r.features) * 1000000) AS BIGINT) AS sim
 FROM profiles q JOIN sets qs ON qs.gene = q.id JOIN profiles r ON q.id <> r.id),
k AS (SELECT id, label, pos, row_number() OVER (PARTITION BY id, label ORDER BY sim DESC, pos) AS rank, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER (PARTITION BY id, label ORDER BY sim DESC, pos ROWS UNBOUNDED PRECEDING) AS npos FROM s),
ap AS (SELECT id, label, avg(npos / rank) FILTER (pos) AS average_precision, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM k GROUP BY 1, 2)"""


@query("q4_set_consistency", f"WITH {CONS} SELECT 'all' AS variant, * FROM ap", doubles="average_precision")
def q4(spark, sf):
    return Q.consistency(T.profiles(spark, sf).select("id", "features"), sets(spark, sf))


@query("q5_consistency_per_category", f"WITH {CONS} SELECT label AS category, avg(average_precision) AS mean_map, count(*) AS n_genes FROM ap GROUP BY 1 HAVING count(*) >= 3", doubles="mean_map")
def q5(spark, sf):
    ap = Q.consistency(T.profiles(spark, sf).select("id", "features"), sets(spark, sf), minimum=3)
    return ap.groupBy(F.col("label").alias("category")).agg(F.avg("average_precision").alias("mean_map"), F.count(F.lit(1)).alias("n_genes"))


@query("q6_significance")
def q6(spark, sf):
    return Q.significance(Q.activity(T.profiles(spark, sf), control()), 2000)


@query("q6_significant_ratio")
def q6r(spark, sf):
    return Q.significant_ratio(Q.significance(Q.distinctiveness(T.profiles(spark, sf), control()), 2000))


@query("q7_weighted_auc", """WITH s AS (SELECT c_mktsegment AS variant, c_nationkey AS label, avg(c_acctbal) / 10000 AS mean_average_precision, 1.0 / count(*) AS corrected_p_value FROM customer GROUP BY 1, 2)
SELECT variant, avg(mean_average_precision * least(greatest(-log10(corrected_p_value), 0), 6) / 6) AS auc FROM s GROUP BY 1""", doubles="auc")
def q7(spark, sf):
    s = T.read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("variant"), "c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("mean_average_precision"), (1 / F.count(F.lit(1))).alias("corrected_p_value"))
    return Q.auc_score(s)


@query("q8_threshold_sweep_auc", f"""WITH {ACT}, m AS (SELECT label, round(avg(average_precision), 6) AS m FROM ap GROUP BY 1), g AS (SELECT i, avg(CASE WHEN m >= i / 100.0::DOUBLE THEN 1.0 ELSE 0 END) AS f FROM m, range(101) t(i) GROUP BY 1)
SELECT 'all' AS variant, sum(f * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1 END / 100) AS sweep_auc FROM g""", doubles="sweep_auc")
def q8(spark, sf):
    m = Q.mean_average_precision(Q.activity(T.profiles(spark, sf), control()))
    return Q.sweep_auc(m.withColumn("mean_average_precision", F.round("mean_average_precision", 6)))


def battery(profiles, subsets):
    return Q.mean_average_precision(Q.activity(profiles, control(), subsets)).withColumnRenamed("label", "perturbation")


def significant_battery(profiles, subsets):
    return Q.significance(Q.activity(profiles, control(), subsets), 1000)


def _masked(labels):
    """SQL vector of the dims of the given reporters."""
    return " || ".join(f"features[{16 * int(r[1]) + 1}:{16 * int(r[1]) + 16}]" for r in sorted(labels))


def _variants_sql(variants):
    """Mean average precision per (variant, perturbation) for many subsets, as one union."""
    parts = []
    for name, labels in variants.items():
        parts.append(f"SELECT '{name}' AS variant, * FROM (WITH {ap_sql(chr(113) + '.perturbation <> ' + chr(39) + '0' + chr(39), 'r.perturbation = ' + chr(39) + '0' + chr(39), sub=_masked(labels))} SELECT label AS perturbation, avg(average_precision) AS m, count(*) AS n_queries FROM ap GROUP BY 1)")
    return " UNION ALL ".join(parts)


@query("q11_q16_reporter_battery", f"SELECT variant, perturbation, m AS mean_average_precision, n_queries FROM ({_variants_sql({r: [r] for r in REPORTERS})})", doubles="mean_average_precision")
def q16(spark, sf):
    return battery(T.profiles(spark, sf), REPORTERS)


_SUB = {}
for _mask in range(1, 16):
    _labels = [f"r{i}" for i in range(4) if _mask >> i & 1]
    _SUB["+".join(_labels)] = _labels
_SCORES_SQL = f"sc AS (SELECT variant, avg(m) AS s FROM ({_variants_sql(_SUB)}) GROUP BY 1)"


def _key(exprs):
    return f"array_to_string(list_sort({exprs}), '+')"


@query("q12_backward_elimination", f"""WITH {_SCORES_SQL}, s0 AS (SELECT ['r0', 'r1', 'r2', 'r3'] AS l),
s1 AS (SELECT c AS d, [x for x in l if x <> c] AS l, s FROM (SELECT l, unnest(l) AS c FROM s0) JOIN sc ON variant = {_key("[x for x in l if x <> c]")} ORDER BY s DESC, c LIMIT 1),
s2 AS (SELECT c AS d, [x for x in l if x <> c] AS l, sc.s FROM (SELECT l, unnest(l) AS c FROM s1) JOIN sc ON variant = {_key("[x for x in l if x <> c]")} ORDER BY sc.s DESC, c LIMIT 1),
s3 AS (SELECT c AS d, [x for x in l if x <> c] AS l, sc.s FROM (SELECT l, unnest(l) AS c FROM s2) JOIN sc ON variant = {_key("[x for x in l if x <> c]")} ORDER BY sc.s DESC, c LIMIT 1)
SELECT 0 AS step, '(none)' AS label, 4 AS n_remaining, s AS score FROM sc WHERE variant = 'r0+r1+r2+r3' UNION ALL SELECT 1, d, 3, s FROM s1 UNION ALL SELECT 2, d, 2, s FROM s2 UNION ALL SELECT 3, d, 1, s FROM s3""", doubles="score")
def q12(spark, sf):
    return AT.backward_elimination(T.profiles(spark, sf), REPORTERS, battery)


def _fwd(prev):
    return f"""(SELECT c AS d, list_append(l, c) AS l, sc.s FROM (SELECT l, unnest([x for x in ['r0', 'r1', 'r2', 'r3'] if NOT list_contains(l, x)]) AS c FROM {prev}) JOIN sc ON variant = {_key("list_append(l, c)")} ORDER BY sc.s DESC, c LIMIT 1)"""


@query("q13_forward_selection", f"""WITH {_SCORES_SQL}, s1 AS (SELECT 'r2' AS d, ['r2'] AS l, s FROM sc WHERE variant = 'r2'), s2 AS {_fwd("s1")}, s3 AS {_fwd("s2")}, s4 AS {_fwd("s3")}
SELECT 1 AS step, d AS label, 1 AS n_selected, s AS score FROM s1 UNION ALL SELECT 2, d, 2, s FROM s2 UNION ALL SELECT 3, d, 3, s FROM s3 UNION ALL SELECT 4, d, 4, s FROM s4""", doubles="score")
def q13(spark, sf):
    return AT.forward_selection(T.profiles(spark, sf), REPORTERS, battery, first="r2")


_LOO = {"full": list(REPORTERS), **{r: [x for x in REPORTERS if x != r] for r in REPORTERS}}


@query("q14_perturbation_deltas", f"""WITH v AS ({_variants_sql(_LOO)}) SELECT a.variant AS label, perturbation, b.m AS baseline, a.m AS ablated, b.m - a.m AS delta FROM v a JOIN v b USING (perturbation) WHERE a.variant <> 'full' AND b.variant = 'full'""", doubles="baseline ablated delta")
def q14(spark, sf):
    return AT.perturbation_deltas(AT.leave_one_out(T.profiles(spark, sf), REPORTERS, battery), flag=None)


@query("q15_attribution_matrix", f"""WITH v AS ({_variants_sql(_LOO)}) SELECT perturbation, {", ".join(f"max(b.m - a.m) FILTER (a.variant = '{r}') AS {r}" for r in REPORTERS)} FROM v a JOIN v b USING (perturbation) WHERE a.variant <> 'full' AND b.variant = 'full' GROUP BY 1""", doubles="r0 r1 r2 r3")
def q15(spark, sf):
    d = AT.perturbation_deltas(AT.leave_one_out(T.profiles(spark, sf), REPORTERS, battery), flag=None)
    return AT.attribution_matrix(d, list(REPORTERS))


@query("q15_attribution_summary", f"""WITH v AS ({_variants_sql(_LOO)}), s AS (SELECT variant, avg(m) AS mean_map, max(m) AS max_map FROM v GROUP BY 1) SELECT a.variant AS label, a.mean_map, a.max_map, b.mean_map - a.mean_map AS delta_mean_map, b.max_map - a.max_map AS delta_max_map,
 (b.mean_map - a.mean_map + b.max_map - a.max_map) / 2 AS avg_delta FROM s a JOIN s b ON b.variant = 'full' WHERE a.variant <> 'full'""", doubles="mean_map max_map delta_mean_map delta_max_map avg_delta")
def q15s(spark, sf):
    v = AT.leave_one_out(T.profiles(spark, sf), REPORTERS, battery)
    s = v.groupBy("variant").agg(F.avg("mean_average_precision").alias("mean_map"), F.max("mean_average_precision").alias("max_map"))
    return AT.attribution_summary(s, ["mean_map", "max_map"], ["mean_map", "max_map"])


@query("q15_dependency_table")
def q15d(spark, sf):
    v = AT.leave_one_out(T.profiles(spark, sf), REPORTERS, significant_battery)
    return AT.dependency_table(AT.perturbation_deltas(v))


@query("q27_group_columns", """WITH n AS (SELECT DISTINCT replace(p_type, ' ', '') || '_PC' || p_size AS feature, replace(p_type, ' ', '') AS base FROM part) SELECT CASE WHEN base IN (SELECT DISTINCT replace(p_type, ' ', '') FROM part WHERE p_retailprice < 950) THEN base ELSE 'unknown (' || base || ')' END AS label, feature FROM n""")
def q27(spark, sf):
    p = T.read(spark, sf, "part")
    base = F.replace("p_type", F.lit(" "), F.lit(""))
    names = p.select(F.concat(base, F.lit("_PC"), F.col("p_size").cast("string")).alias("feature")).distinct()
    return AT.group_columns(names, p.where("p_retailprice < 950").select(base.alias("label")))
