"""Vectors as packed doubles, and the rows that take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not zero, not empty; false instead of null."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def packed(rows: DataFrame, vector: str, *carried: str) -> DataFrame:
    """``carried`` columns and ``v``: the vector as packed little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.array(x, "<f8").tobytes() for x in b.column("__v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.binary())], names=[*carried, "v"])

    kept = rows.select(*carried, F.col(vector).cast("array<double>").alias("__v"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, v binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
