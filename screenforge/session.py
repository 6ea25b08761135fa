"""Session helpers: settings the operators rely on and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

GROUP_LIMIT_KEY = "spark.screenforge.groupLimit"
GROUP_LIMIT_DEFAULT = 2_000_000
#: Spark's setting to delete the shuffle files of a query when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, name: str = "screenforge") -> SparkSession:
    """Session for tests and the benchmark; on a cluster pass the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # exact medians of many small groups: stay in the hash aggregate longer before sorting
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def group_limit(spark: SparkSession) -> int:
    """Most rows of one group that a single task may sort or hold."""
    return int(spark.conf.get(GROUP_LIMIT_KEY, str(GROUP_LIMIT_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors share.

    It is the session's own ``spark.checkpoint.dir``; a temporary folder is set only when the
    session names none and Spark runs in local mode.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run meanwhile go when these end."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, and sizes that the optimiser sees as they are.

    A checkpoint keeps the estimate of its plan, which multiplies when a loop joins its own results.
    Shuffle files of the write go when it ends; the written files are all that is read afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("stored-"):
                folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
