"""Queries without an SQL twin read all clusters and dimensions."""

import os

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_subclusters_of_every_cluster(spark):
    rows = entry.queries()["m11_subclusters"](spark, SF).collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect() if r[0] is not None}
    got = {}
    for r in rows:
        got[r["cluster"]] = got.get(r["cluster"], 0) + r["n"]
    assert len(labels) > 3 and got == labels


def test_cohesion_in_every_space(spark):
    rows = entry.queries()["m20_cohesion_per_space"](spark, SF).collect()
    assert {r["organelle"] for r in rows} == {"r0", "r1", "r2", "r3"}
