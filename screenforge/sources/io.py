"""Readers and writers for batches, wells, level tables, gene sets and result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.functions.scalars import finite, metric_unit, parse_bbox, parse_feature, relabel_control, safe_number
from screenforge.operators.skew import first_row


# --- reading ----------------------------------------------------------------------------------
def read_batches(spark: SparkSession, paths: str | Sequence[str], skip_unreadable: bool = False) -> DataFrame:
    """All batch files as one table; schemas merge. Unreadable files fail the read unless skipping is asked for; see ``unreadable_files``."""
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_unreadable).lower())
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def unreadable_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes) of the files under ``folder`` that are no whole Parquet file: what a skipping read leaves out.

    A Parquet file starts and ends with its four-byte mark; every file is looked at by a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    mark = F.lit(bytearray(b"PAR1"))
    whole = (F.col("length") >= 12) & (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)
    return files.where(~whole).select("path", F.col("length").alias("bytes"))


def read_partition(spark: SparkSession, path: str, batch: str, column: str = "batch_id", columns: Sequence[str] = ()) -> DataFrame:
    """One batch; the filter and the column list reach the scan."""
    df = spark.read.parquet(path).where(F.col(column) == batch)
    return df.select(*columns) if columns else df


def read_wells(spark: SparkSession, path: str, schema: str, store_key: str, pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """One CSV per well; the well comes from the file name and slashes in it from underscores."""
    df = spark.read.schema(schema).option("header", "true").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.withColumns({"well": F.replace(name, F.lit("_"), F.lit("/")), "store_key": F.lit(store_key)})


def prefer_linked(stain: DataFrame | None, linked: DataFrame) -> DataFrame:
    """The stain table where it exists and has rows, else the linked table."""
    return linked if stain is None or stain.isEmpty() else stain


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """`obj_chunks/<organelle>/chunk_*.parquet` with the organelle read off the directory."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.withColumn("organelle", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.parquet$", 1))


def load_profiles(x: DataFrame, obs: DataFrame, key: str = "id", bbox: Sequence[str] = (), numbers: Sequence[str] = (), gene: str | None = None) -> DataFrame:
    """Values and row metadata as one table: boxes parsed, coordinates numeric, gene '0' named NTC."""
    df = x.join(obs, key)
    for b in bbox:
        df = df.withColumn(b, parse_bbox(F.col(b)))
    for n in numbers:
        df = df.withColumn(n, safe_number(n))
    return df if gene is None else df.withColumn(gene, relabel_control(F.col(gene)))


def feature_metadata(names: DataFrame, organelles: Sequence[str]) -> DataFrame:
    """One row per feature: organelle (``_unassigned`` if unknown), metric, category, aggregation, unit."""
    p = names.select("feature", parse_feature(F.col("feature"), organelles).alias("p")).select("feature", "p.*")
    return p.withColumns({"organelle": F.coalesce("organelle", F.lit("_unassigned")), "unit": metric_unit(F.col("metric"))})


def gene_sets(sets: DataFrame, skip: Sequence[str] = (), minimum: int = 1) -> DataFrame:
    """(set_id, set_name, genes array) -> (set_id, set_name, gene) without skipped or small sets."""
    kept = sets.where(~F.col("set_name").isin(list(skip)) if skip else F.lit(True))
    kept = kept.where(F.size(F.array_distinct("genes")) >= minimum)
    return kept.select("set_id", "set_name", F.explode(F.array_distinct("genes")).alias("gene"))


def combine_by_signal(tables: Iterable[DataFrame], guide: str, signal: str, features: str, signals: Sequence[str], join: str = "outer") -> DataFrame:
    """Pool experiments of one signal, put different signals side by side; inner keeps complete guides."""
    pooled = None
    for t in tables:
        pooled = t if pooled is None else pooled.unionByName(t, allowMissingColumns=True)
    wide = pooled.groupBy(guide).agg(
        *[F.avg(F.when(F.col(signal) == s, F.col(features))).alias(f"{s}_{features}") for s in signals],
        F.count_distinct(signal).alias("n_signals"),
    )
    return wide.where(F.col("n_signals") == len(signals)) if join == "inner" else wide


def channel_files(files: DataFrame, roots: Sequence[str], excluded: Sequence[str] = (), skip_prefixes: Sequence[str] = ("umap_", "CP1_", "CP2_", "."), by: str = "path") -> DataFrame:
    """(experiment, channel, path) from listed paths ``<root>/<experiment>/<channel>.<ext>``; the first root wins.

    Of several files in that root the one with the smallest ``by`` is taken, a column that the result then has too.
    """
    p = F.col("path")
    root = F.array_position(F.array(*[F.lit(r) for r in roots]), F.regexp_extract(p, r"^(.*)/[^/]+/[^/]+$", 1))
    t = files.select(
        *dict.fromkeys(["path", by]), root.alias("__root"), F.regexp_extract(p, r"/([^/]+)/[^/]+$", 1).alias("experiment"),
        F.regexp_extract(p, r"/([^/]+?)(\.[^./]+)?$", 1).alias("channel"),
    ).where((F.col("__root") > 0) & ~F.col("channel").isin(list(excluded)))
    for s in skip_prefixes:
        t = t.where(~F.col("channel").startswith(s))
    return first_row(t, ["experiment", "channel"], [F.col("__root"), F.col(by), F.col("path")]).drop("__root")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of files without reading their content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "modificationTime")


def remaining(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose key is not in the finished outputs."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def outer_concat(blocks: Sequence[DataFrame], features: Sequence[str]) -> DataFrame:
    """Blocks with different feature sets under one schema, missing features 0."""
    out = None
    for b in blocks:
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    return out.fillna(0.0, list(features))


def collect_summaries(parts: Sequence[DataFrame], key: str, order: Column) -> DataFrame:
    """Stored summaries of many comparisons, one row per key, the first by ``order``."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return first_row(out, [key], [order])


def append_by_id(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Embedding coordinates or cluster labels back onto the table; rows without any stay."""
    return df.join(extra, key, "left")


# --- writing ----------------------------------------------------------------------------------
def write_levels(levels: dict[str, DataFrame], path: str, keys: dict[str, Sequence[str]], organelles: Sequence[str]) -> None:
    """Per level: float features, row metadata, and one shared feature table."""
    spark = next(iter(levels.values())).sparkSession
    seen: set[str] = set()
    for level, df in levels.items():
        obs = [c for c in keys[level] if c in df.columns]
        feats = [c for c, t in df.dtypes if c not in obs and t in ("double", "float", "bigint", "int")]
        seen.update(feats)
        ids = obs[:1]
        df.select(*ids, *[finite(F.col(f)).cast("float").alias(f) for f in feats]).write.mode("overwrite").parquet(f"{path}/{level}/x")
        df.select(*obs).write.mode("overwrite").parquet(f"{path}/{level}/obs")
    names = spark.createDataFrame([(n,) for n in sorted(seen)], "feature string")
    feature_metadata(names, organelles).write.mode("overwrite").parquet(f"{path}/feature_meta")


def write_intermediate(df: DataFrame, path: str, ids: Sequence[str], timing_path: str | None = None) -> None:
    """Parquet with text ids; internal columns go to the timing table."""
    internal = [c for c in df.columns if c.startswith("_")]
    texts = {i: F.col(i).cast("string") for i in ids}
    df.drop(*internal).withColumns(texts).write.mode("overwrite").parquet(path)
    if timing_path and internal:
        df.select(*ids, *internal).withColumns(texts).write.mode("overwrite").parquet(timing_path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
