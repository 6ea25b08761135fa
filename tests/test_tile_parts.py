"""Tiles of many parts: what leaves a tile is combined, and equal distances go by id however many there are."""

import numpy as np
import pyarrow as pa
import pytest

from screenforge.operators import pairs as PR


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (90, 2)).astype(float)  # nine places only, about ten copies each
    x[:40] = [1.0, 1.0]
    df = spark.createDataFrame([(i, str(i % 4), x[i].tolist()) for i in range(90)], "id long, g string, features array<double>")
    return x, df.cache()


@pytest.mark.parametrize(("block", "right"), [(6, 1 << 18), (6, 30), (1000, 1 << 18)])
def test_copies_by_id_and_sums(points, block, right, monkeypatch):
    x, df = points
    monkeypatch.setattr(PR, "RIGHT_ROWS", right)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r["id"], r["rank"]): r["ref_id"] for r in PR.nearest(df, df, 3, block_rows=block).collect()}
    for i in range(90):
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in sorted((d[i, j], j) for j in range(90) if j != i)[:3]]
    sums = PR.group_distances(df, df, "g", block).collect()
    assert len(sums) == 360
    for r in sums:
        js = [j for j in range(90) if j != r["id"] and str(j % 4) == r["ref_group"]]
        assert (r["n"], r["total"], r["largest"]) == (len(js), pytest.approx(d[r["id"], js].sum()), pytest.approx(d[r["id"], js].max()))


def test_a_query_leaves_a_tile_once(points):
    _, df = points
    q = df.select("id", "features")
    r = df.selectExpr("id AS ref_id", "features")
    one = lambda a, b: pa.table({"id": a.column("id"), "n": pa.array([b.num_rows] * a.num_rows, pa.int64())})
    rows = PR.tile_reduce(q, r, one, "id long, n long", lambda t: PR.summed(t, ["id"], {"n": "sum"}), 6, right_id="ref_id").collect()
    assert sorted((r["id"], r["n"]) for r in rows) == [(i, 90) for i in range(90)]
