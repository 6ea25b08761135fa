"""Graph operators on edge tables: skeleton networks, components, relabelling, membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenforge.session import checkpointed


# --- skeleton networks ------------------------------------------------------------------------
def skeleton_summary(branches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Branch count, total and mean length, mean thickness per skeleton."""
    return branches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_branches"), F.sum("branch_length").alias("total_length"),
        F.avg("branch_length").alias("mean_length"), F.avg("branch_thickness").alias("mean_thickness"),
    )


def fragments_to_objects(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skeleton fragments of one object: counts and lengths add, mean lengths average."""
    return fragments.groupBy(*keys).agg(
        F.sum("n_branches").alias("n_branches"), F.sum("total_length").alias("total_length"),
        F.avg("mean_length").alias("mean_length"), F.count(F.lit(1)).alias("n_fragments"),
    )


def network_summary(branches: DataFrame, keys: Sequence[str], areas: DataFrame | None = None, area: str = "area") -> DataFrame:
    """Branches, junctions, endpoints, mean junction degree, lengths, densities and components per network.

    A node is a junction if any of its branches has type 1 or 2, an endpoint if it only ends
    type 0 branches; both follow from one aggregation per node.
    """
    ends = branches.select(*keys, "branch_type", F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("degree"), F.bool_or(F.col("branch_type") > 0).alias("junction"), F.bool_or(F.col("branch_type") < 2).alias("tip")
    )
    j = F.col("junction")
    per_node = nodes.groupBy(*keys).agg(
        F.count_if(j).alias("num_nodes"), F.count_if(F.col("tip") & ~j).alias("num_endpoints"),
        F.coalesce(F.avg(F.when(j, F.col("degree"))), F.lit(0.0)).alias("average_degree"),
    )
    parts = branches.groupBy(*keys, "skeleton_id").agg(F.count(F.lit(1)).alias("c"), F.sum("branch_length").alias("l"))
    per_net = parts.groupBy(*keys).agg(
        F.sum("c").alias("num_branches"), F.sum("l").alias("total_branch_length"), F.max("l").alias("largest_component_length"),
        F.count(F.lit(1)).alias("num_skeleton_components"),
    )
    out = per_net.join(per_node, list(keys))
    if areas is None:
        return out
    return out.join(areas, list(keys)).withColumns({
        "network_length_density": F.try_divide(F.col("total_branch_length"), F.col(area)), "branching_density": F.try_divide(F.col("num_nodes"), F.col(area)),
    })


def tortuosity(branches: DataFrame, length: str, chord: str) -> DataFrame:
    """Length over chord; 1 where the chord is 0."""
    return branches.withColumn("tortuosity", F.coalesce(F.try_divide(F.col(length), F.col(chord)), F.lit(1.0)))


# --- components -------------------------------------------------------------------------------
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) with the smallest node id of each component as its root.

    Alternating large-star and small-star steps reach a star forest in a logarithmic number of
    rounds. A round is one combinable minimum per node and one join on the node; a hub's edges
    are split by AQE's skew join. Every round ends in a reliable checkpoint.
    """
    all_nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    e = edges.where(F.col(src) != F.col(dst)).select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    ).distinct()
    e = checkpointed(e)
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return all_nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def global_labels(tiles: DataFrame, tile_order: Sequence[str], label: str = "label", image: str = "image") -> DataFrame:
    """Labels made unique by the running maximum of labels of earlier tiles of the image."""
    top = tiles.groupBy(image, *tile_order).agg(F.max(label).alias("__m"))
    w = Window.partitionBy(image).orderBy(*tile_order).rowsBetween(Window.unboundedPreceding, -1)
    off = top.select(image, *tile_order, F.coalesce(F.sum("__m").over(w), F.lit(0)).alias("__off"))
    return tiles.join(off, [image, *tile_order]).withColumn("global_label", F.when(F.col(label) > 0, F.col(label) + F.col("__off")).otherwise(F.lit(0))).drop("__off")


def relabel(rows: DataFrame, components: DataFrame, label: str = "global_label") -> DataFrame:
    """Labels replaced by the root of their component; labels outside any pair keep their id."""
    c = components.select(F.col("node").alias(label), F.col("component").alias("__c"))
    return rows.join(c, label, "left").withColumn("object_id", F.coalesce("__c", label)).drop("__c")


def recursive_members(parents: DataFrame, members: DataFrame, cluster: str = "cluster", parent: str = "parent", gene: str = "gene") -> DataFrame:
    """(cluster, gene) with the genes of all descendants.

    One join with the hierarchy per level, until no new pair appears; pairs seen before are left
    out, so a cycle ends. The frontier is checkpointed so the plan stays short.
    """
    pairs = members.select(F.col(cluster).alias("__c")).union(parents.select(F.col(cluster).alias("__c"))).distinct()
    frontier = pairs.select(F.col("__c").alias("ancestor"), F.col("__c").alias("node"))
    reach = frontier
    links = parents.where(F.col(parent).isNotNull()).select(F.col(cluster).alias("child"), F.col(parent).alias("node"))
    while True:
        frontier = checkpointed(frontier.join(links, "node").select("ancestor", F.col("child").alias("node")).distinct().join(reach, ["ancestor", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        reach = reach.union(frontier)
    out = reach.join(members.select(F.col(cluster).alias("node"), gene), "node")
    return out.select(F.col("ancestor").alias(cluster), gene).distinct()
