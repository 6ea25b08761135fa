"""Gene sets and categories: assignment, enrichment, themes, radar tables and score matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.functions.special import hypergeom_tail
from screenforge.operators.skew import bh_adjust, first_row, top_n


# --- text and name rules ----------------------------------------------------------------------
def keyword_scores(text: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """Array of (category, hits): how many of a category's keywords occur in the lower-cased text.

    The keyword list is configuration, so it becomes one row-local expression over the whole text
    instead of a join.
    """
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return F.array(*[F.struct(F.lit(c).alias("category"), hits(ws).alias("hits")) for c, ws in sorted(keywords.items())])


def best_keyword_category(df: DataFrame, text: str, keywords: dict[str, Sequence[str]]) -> DataFrame:
    """Category with most keyword hits (at least one), ties to the first name; null otherwise."""
    ordered = F.array_sort(F.transform(keyword_scores(F.col(text), keywords), lambda s: F.struct((-s["hits"]).alias("n"), s["category"].alias("category"))))
    best = ordered[0]
    return df.withColumns({"category": F.when(best["n"] < 0, best["category"]), "hits": -best["n"]})


def regex_category(name: Column, patterns: dict[str, Sequence[str]]) -> Column:
    out = None
    for category, regexes in patterns.items():
        hit = name.rlike("|".join(f"(?:{r})" for r in regexes))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def assign_categories(genes: DataFrame, clusters: DataFrame, annotations: DataFrame, keywords: dict[str, Sequence[str]], patterns: dict[str, Sequence[str]], overrides: DataFrame) -> DataFrame:
    """(gene, category, pass): pass 1 cluster membership, 2 keyword score, 3 name pattern, 4 override table; the first hit wins."""
    p1 = genes.join(clusters.select("gene", "category"), "gene").select("gene", "category", F.lit(1).alias("pass"))
    p2 = best_keyword_category(annotations.join(genes.select("gene"), "gene", "left_semi"), "text", keywords).where(F.col("category").isNotNull()).select("gene", "category", F.lit(2).alias("pass"))
    p3 = genes.select("gene", regex_category(F.col("gene_name"), patterns).alias("category"), F.lit(3).alias("pass")).where(F.col("category").isNotNull())
    p4 = genes.join(overrides.select("gene", "category"), "gene").select("gene", "category", F.lit(4).alias("pass"))
    return first_row(p1.unionByName(p2).unionByName(p3).unionByName(p4), ["gene"], [F.col("pass"), F.col("category")])


def cluster_theme(members: DataFrame, cluster: str, name: str, keywords: dict[str, Sequence[str]]) -> DataFrame:
    """Theme of a cluster from keywords in its members' names: a category with 30 % of members, with
    15 % marked ``?``, else the top two, else Mixed or Uncharacterized. Ties follow keyword order."""
    up = F.upper(F.col(name))
    order = list(keywords)
    counts = [F.count_if(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(up, w))).alias(f"c{i}") for i, ws in enumerate(keywords.values())]
    g = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_genes"), *counts)
    ranked = F.array_sort(F.filter(
        F.array(*[F.struct((-F.col(f"c{i}")).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(order)]), lambda s: s["k"] < 0
    ))
    r = g.select(cluster, "n_genes", ranked.alias("r"))
    share = -F.col("r")[0]["k"] / F.col("n_genes") * 100
    theme = (
        F.when(F.size("r") == 0, "Uncharacterized").when(share >= 30, F.col("r")[0]["name"]).when(share >= 15, F.concat(F.col("r")[0]["name"], F.lit("?")))
        .when(F.size("r") >= 2, F.concat_ws("/", F.get("r", F.lit(0))["name"], F.get("r", F.lit(1))["name"])).otherwise("Mixed")
    )
    return r.select(cluster, "n_genes", theme.alias("theme"))


# --- enrichment -------------------------------------------------------------------------------
def cluster_enrichment(members: DataFrame, cluster: str = "cluster", gene: str = "gene", minimum: int = 2) -> DataFrame:
    """One-sided Fisher test of each gene in each cluster, odds ratio, BH within the cluster.

    The 2×2 tables come from three counted group-bys; rare pairs leave before the test.
    """
    pair = members.groupBy(cluster, gene).agg(F.count(F.lit(1)).alias("n_in"))
    size, total = pair.groupBy(cluster).agg(F.sum("n_in").alias("n_cluster")), pair.groupBy(gene).agg(F.sum("n_in").alias("n_gene"))
    everything = pair.select(F.sum("n_in")).scalar()
    j = pair.where(F.col("n_in") >= minimum).join(size, cluster).join(total, gene).withColumn("n_all", everything)
    a, b = F.col("n_in"), F.col("n_cluster") - F.col("n_in")
    c = F.col("n_gene") - F.col("n_in")
    d = F.col("n_all") - F.col("n_cluster") - c
    t = j.withColumns({"odds_ratio": F.try_divide(a * d, b * c), "p": hypergeom_tail(a, "n_all", "n_gene", "n_cluster")})
    return bh_adjust(t, [cluster], "p").select(cluster, gene, "n_in", "n_cluster", "n_gene", "odds_ratio", "p", "p_adj")


def over_representation(lists: DataFrame, sets: DataFrame, background: DataFrame, keys: Sequence[str], gene: str = "gene", min_list: int = 5, top: int = 3) -> DataFrame:
    """Gene lists per key against gene sets over a background: hypergeometric p, BH per key, best terms."""
    bg = background.select(gene).distinct()
    inside_sets = sets.select("set_id", gene).distinct().join(bg, gene, "left_semi")
    m = bg.select(F.count(F.lit(1))).scalar()
    l = lists.select(*keys, gene).distinct().join(bg, gene, "left_semi")
    sizes = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_list")).where(F.col("n_list") >= min_list)
    set_sizes = inside_sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_set"))
    hit = l.join(inside_sets, gene).groupBy(*keys, "set_id").agg(F.count(F.lit(1)).alias("overlap"), F.array_join(F.sort_array(F.collect_list(gene)), ",").alias("genes"))
    j = hit.join(sizes, list(keys)).join(set_sizes, "set_id").withColumn("n_all", m)
    t = j.withColumn("p", hypergeom_tail("overlap", "n_all", "n_set", "n_list"))
    a = bh_adjust(t, keys, "p")
    return top_n(a, keys, [F.round("p", 12), F.col("overlap").desc(), F.col("set_id")], top)


def term_matrix(terms: DataFrame, direction: str, features: Sequence[str]) -> DataFrame:
    """-log10 p of each term by feature for one direction."""
    t = terms.where(F.col("direction") == direction).withColumn("score", -F.log10(F.greatest("p", F.lit(1e-300))))
    return t.groupBy("set_id").pivot("feature", list(features)).agg(F.max("score"))


def annotation_text(enriched: DataFrame, cluster: str = "cluster", gene: str = "gene", n: int = 5) -> DataFrame:
    """``gene (2.5×)`` for the n largest odds ratios of each cluster, in order."""
    top = top_n(enriched.where(F.col("odds_ratio").isNotNull()), [cluster], [F.col("odds_ratio").desc(), F.col(gene)], n)
    text = F.concat(F.col(gene), F.lit(" ("), F.format_number("odds_ratio", 1), F.lit("×)"))
    listed = top.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))).alias("l"))
    return listed.select(cluster, F.array_join(F.transform("l", lambda s: s["t"]), ", ").alias("annotation"))


# --- tables -----------------------------------------------------------------------------------
def cluster_gene_lists(labels: DataFrame, cluster: str = "cluster", gene: str = "gene") -> DataFrame:
    d = labels.select(cluster, gene).distinct()
    return d.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_genes"), F.array_join(F.sort_array(F.collect_list(gene)), ",").alias("genes"))


def radar_matrix(scores: DataFrame, mapping: DataFrame, value: str = "mean_average_precision", minimum: int = 3) -> DataFrame:
    """(reporter, category, score): mean value of a category's genes, 0 below ``minimum`` genes, without
    ``Other`` and without categories that are 0 for every reporter."""
    j = scores.join(mapping.where(F.col("category") != "Other"), "gene")
    v = F.avg(F.col(value).cast("double"))
    s = j.groupBy("reporter", "category").agg(F.when(F.count(F.lit(1)) >= minimum, v).otherwise(0.0).alias("score"), F.count(F.lit(1)).alias("n_genes"))
    live = s.groupBy("category").agg(F.max(F.abs("score")).alias("m")).where(F.col("m") > 0).select("category")
    return s.join(live, "category", "left_semi")


def reporter_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("reporter").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("below_corrected_p").cast("double")).alias("ratio"), F.avg("mean_average_precision").alias("mean_map")
    )


def filtered_matrix(scores: DataFrame, baseline: str, minimum: float = 0.05, clip: float = 1.0) -> DataFrame:
    """Genes whose baseline score reaches ``minimum``, each reporter's score over the baseline, clipped."""
    base = scores.where(F.col("reporter") == baseline).select("gene", F.col("score").alias("__b")).where(F.col("__b") >= minimum)
    return scores.join(base, "gene").withColumn("normalised", F.least(F.try_divide(F.col("score"), F.col("__b")), F.lit(clip))).drop("__b")


def category_strip(matrix: DataFrame, reporters: Sequence[str], mapping: DataFrame, category: str, n: int = 3) -> DataFrame:
    """Long strip of a category's genes per reporter, the reporter's mean and the genes to label at both ends."""
    genes = mapping.where(F.col("category") == category).select("gene").distinct()
    long = matrix.join(genes, "gene", "left_semi").unpivot(["gene"], list(reporters), "reporter", "score").where(F.col("score").isNotNull())
    w = Window.partitionBy("reporter")
    hi, lo = F.row_number().over(w.orderBy(F.col("score").desc(), "gene")), F.row_number().over(w.orderBy(F.col("score").asc(), "gene"))
    r = long.withColumns({"reporter_mean": F.avg("score").over(w), "hi": hi, "lo": lo})
    return r.withColumn("label", F.when(F.col("hi") <= n, "top").when(F.col("lo") <= n, "bottom")).drop("hi", "lo")


def representative_rows(items: DataFrame, rows: DataFrame, group: str, item: str, row: str, n: int) -> DataFrame:
    """Best rows of ranked items; a row that several items claim goes to its best-ranked item."""
    r = rows.join(items.select(group, item, F.col("rank").alias("item_rank")), [group, item])
    owned = first_row(r, [row], [F.col("item_rank"), F.col(group), F.col(item)])
    return top_n(owned, [group, item], [F.col("score").desc(), F.col(row)], n, "row_rank")
