"""Words, Arrow batches and small numeric helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.session import checkpointed

#: Rows of text that a worker holds as Python objects at once.
SLICE_ROWS = 256
#: Rows of an Arrow batch of whole texts, and Spark's setting for it.
BATCH_ROWS, BATCH_KEY = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session; a smaller setting stays.

    A batch of whole texts is held by the executor and by its worker at the same time, and Spark
    reads the setting when a result is computed, so it holds for the session.
    """
    if not 0 < int(spark.conf.get(BATCH_KEY, "10000")) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def checkpointed_as_dealt(df: DataFrame) -> DataFrame:
    """A checkpoint whose reader knows how the rows are dealt out, so that a join on that key moves the other side only.

    The plan has to be final before it runs for that, so it is not adapted meanwhile.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return checkpointed(df)
    finally:
        conf.set(key, before)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that long texts do not pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every bit of ``x`` over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash64(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def sampled(rows: DataFrame, key: Column, total: int, limit: int) -> DataFrame:
    """About ``limit`` of ``total`` rows, chosen by a hash of ``key``; all rows if there are fewer."""
    if total <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(limit / total * (1 << 30)))
