"""Nearest neighbours by randomly rotated one-bit codes.

A random rotation spreads a vector's weight over all components; the signs of the rotated unit
vector are its code, packed one bit each. With the code's inner product with the vector itself as
correction scalar, the inner product with any query is estimated without bias, and its error is
bounded with high probability. Only vectors whose bound reaches the k-th best are reranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenforge.llm.vectors import matrix, packed, usable
from screenforge.session import checkpointed

#: Rows of a block of candidates and of queries; width of the error bound in standard deviations.
BLOCK, QUERIES, SIGMAS = 8192, 1024, 3.0


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, norm, correction): correction is the inner product of the unit vector with its code."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotation(x.shape[1]).T
    bits = turned >= 0
    return np.packbits(bits, axis=1), norm, np.abs(turned).sum(1) / math.sqrt(x.shape[1])


def estimates(bits: np.ndarray, norm: np.ndarray, correction: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[query, vector] estimated inner products and the half-width of their error bounds."""
    size = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1
    q_norm = np.linalg.norm(queries, axis=1)
    turned = (queries @ rotation(size).T).astype(np.float32)
    about = (turned @ signs.T) / math.sqrt(size) / correction.astype(np.float32) * norm.astype(np.float32)
    error = SIGMAS * np.sqrt(np.maximum(0.0, 1 - correction**2)) / correction / math.sqrt(max(1, size - 1)) * norm
    return about, q_norm[:, None].astype(np.float32) * error.astype(np.float32)


def index(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, v, bits, norm, correction) of every usable row of ``vectors`` (vec_id, embedding)."""
    live = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("size"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                bits, norm, correction = codes(matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(correction)], names=["vec_id", "size", "v", "bits", "norm", "correction"])

    return packed(live, "embedding", "vec_id", "size").mapInArrow(run, "vec_id long, size int, v binary, bits binary, norm double, correction double")


def search(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found of every query row.

    ``vectors`` has vec_id and embedding; only these are read. Queries are the rows that ``is_query``
    selects, candidates all rows with another vec_id. Vectors that are null, empty, zero or hold null
    or non-finite components, and rows without vec_id, take no part; vectors of different lengths do
    not meet. Ties go to the smaller vec_id; equal rows are one. With fewer than k candidates all are
    returned. score is computed in double precision from the original vectors.

    Blocks of queries meet blocks of candidates. In a block the codes give an estimate and an error
    bound for each pair; the k-th best lower bound of the query there excludes most candidates, the
    others are scored exactly and k stay. A query's best over all blocks are ranked at the end.
    """
    table = checkpointed(index(vectors).dropDuplicates(["vec_id", "v"]))
    n, asked = table.count(), table.where(is_query)
    n_blocks, n_queries = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(n_queries)).cast("int")
    left = table.select("size", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("part"), block.alias("block"), F.lit(False).alias("query"), "vec_id", "v", "bits", "norm", "correction")
    right = asked.select("size", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "v", "bits", "norm", "correction")

    def best(key, cell):  # noqa: ANN001, ANN202 - hints would be strings here, which Spark does not read
        is_q = cell.column("query").to_numpy()
        ids, x = cell.column("vec_id").to_numpy(), matrix(cell.column("v"))
        q_at, c_at = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        out_q, out_c, out_s = [], [], []
        if len(q_at) and len(c_at):
            width = -(-x.shape[1] // 8)
            bits = np.frombuffer(b"".join(cell.column("bits").take(pa.array(c_at)).to_pylist()), np.uint8).reshape(-1, width)
            norm, correction = (cell.column(c).to_numpy()[c_at] for c in ("norm", "correction"))
            for at in range(0, len(q_at), 64):
                rows = q_at[at : at + 64]
                about, error = estimates(bits, norm, correction, x[rows])
                low = about - error
                low[ids[rows][:, None] == ids[c_at][None]] = -np.inf
                bar = np.partition(low, -min(k, len(c_at)), axis=1)[:, -min(k, len(c_at))] if len(c_at) else low[:, :0]
                for r, row in enumerate(rows):
                    near = c_at[np.flatnonzero(about[r] + error[r] >= bar[r])]
                    near = near[ids[near] != ids[row]]
                    score = (x[near] * x[row]).sum(1)
                    top = np.lexsort((ids[near], -score))[:k]
                    out_q += [ids[row]] * len(top)
                    out_c += ids[near[top]].tolist()
                    out_s += score[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_c, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = left.unionByName(right).groupBy("size", "part", "block").applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
