"""The standing tables of the checks: screen-shaped views of the given parquet tables.

``SQL`` holds the same views as common table expressions for the SQL side of each check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["area", "intensity_mean", "extent", "eccentricity"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("organelle"),
        F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("intensity_mean"), F.col("l_discount").alias("extent"),
        F.col("l_tax").alias("eccentricity"),
    )


def cells(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("guide"),
        F.col("o_orderpriority").alias("well"), F.col("o_totalprice").alias("cell_area"),
        (F.col("o_orderkey") % 1000).alias("segmentation_id"), F.col("o_orderstatus").alias("status"),
    )


def guides(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("guide"), F.col("c_nationkey").cast("string").alias("gene"),
        F.col("c_mktsegment").alias("batch"), F.col("c_acctbal").alias("gene_effect"),
    )


def genes(spark, sf) -> DataFrame:
    return read(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("gene"), F.col("n_name").alias("gene_name"),
        F.col("n_regionkey").alias("set_id"),
    )


def profiles(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("perturbation"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def branches(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("organelle"),
        F.col("l_linestatus").alias("skeleton_id"), (F.col("l_partkey") % 50).alias("src"),
        (F.col("l_suppkey") % 50).alias("dst"), (F.col("l_linenumber") % 3).alias("branch_type"),
        F.col("l_quantity").alias("branch_length"), F.col("l_tax").alias("branch_thickness"),
        F.col("l_extendedprice").alias("chord"),
    )


def spatial(spark, sf) -> DataFrame:
    ts = F.col("ts")
    minute = F.hour(ts) * 60 + F.minute(ts)
    k = F.get_json_object("props", "$.k").try_cast("double")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("cell_id"), F.col("event_type").alias("well"), F.col("user_id").alias("tile"),
        F.col("value").alias("x"), minute.cast("double").alias("y"), F.col("value").alias("f_value"), k.alias("f_k"),
    )


def gene_cells(spark, sf) -> DataFrame:
    """Cells with their gene and one long row per measured feature of the cell's objects."""
    c = cells(spark, sf).join(guides(spark, sf).select("guide", "gene", "batch"), "guide")
    return c


def object_rows(spark, sf) -> DataFrame:
    """Objects with the guide and gene of their cell."""
    return objects(spark, sf).join(gene_cells(spark, sf).select("cell_id", "guide", "gene", "well", "batch"), "cell_id")


def object_long(spark, sf) -> DataFrame:
    from screenforge.operators.longform import to_long

    return to_long(object_rows(spark, sf), ["cell_id", "organelle", "guide", "gene", "well"], FEATURES)


def pixels(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "v")
    ).select(
        "image", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
        F.col("v").cast("double").alias("intensity"),
    )


OBJECTS = """objects AS (SELECT l_orderkey AS cell_id, l_returnflag AS organelle, l_linenumber AS label,
 l_quantity AS area, l_extendedprice AS intensity_mean, l_discount AS extent, l_tax AS eccentricity FROM lineitem)"""
CELLS = """cells AS (SELECT o_orderkey AS cell_id, o_custkey AS guide, o_orderpriority AS well, o_totalprice AS cell_area,
 o_orderkey % 1000 AS segmentation_id, o_orderstatus AS status FROM orders)"""
GUIDES = """guides AS (SELECT c_custkey AS guide, CAST(c_nationkey AS VARCHAR) AS gene, c_mktsegment AS batch,
 c_acctbal AS gene_effect FROM customer)"""
GENES = """genes AS (SELECT CAST(n_nationkey AS VARCHAR) AS gene, n_name AS gene_name, n_regionkey AS set_id FROM nation)"""
PROFILES = """profiles AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS perturbation, CAST(embedding AS DOUBLE[]) AS features
 FROM embeddings)"""
BRANCHES = """branches AS (SELECT l_orderkey AS cell_id, l_returnflag AS organelle, l_linestatus AS skeleton_id,
 l_partkey % 50 AS src, l_suppkey % 50 AS dst, l_linenumber % 3 AS branch_type, l_quantity AS branch_length,
 l_tax AS branch_thickness, l_extendedprice AS chord FROM lineitem)"""
SPATIAL = """spatial AS (SELECT event_id AS cell_id, event_type AS well, user_id AS tile, value AS x,
 CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS y, value AS f_value,
 TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f_k FROM events)"""
GENE_CELLS = f"{CELLS}, {GUIDES}, gene_cells AS (SELECT c.*, g.gene, g.batch FROM cells c JOIN guides g USING (guide))"
OBJECT_ROWS = f"""{OBJECTS}, {GENE_CELLS}, object_rows AS (SELECT o.*, c.guide, c.gene, c.well, c.batch FROM objects o
 JOIN gene_cells c USING (cell_id))"""
OBJECT_LONG = OBJECT_ROWS + ", object_long AS (" + " UNION ALL ".join(
    f"SELECT cell_id, organelle, guide, gene, well, '{f}' AS feature, {f} AS value FROM object_rows" for f in FEATURES
) + ")"
PIXELS = """pixels AS (SELECT image, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
 CAST(embedding[i] AS DOUBLE) AS intensity FROM (SELECT vec_id AS image, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def cut_shift(digits: int) -> float:
    """Moves rounding cut points off short decimals, where summation order would decide the digit."""
    return 0.0027 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the comparison; NaN and infinities become null."""
    from screenforge.functions.scalars import finite

    return df.select(*[
        F.round(finite(F.col(f.name)) + F.lit(cut_shift(digits)), digits).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])
