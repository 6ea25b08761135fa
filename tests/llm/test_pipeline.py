"""Stages of the pipeline on small documents."""

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage_keeps_the_first_text_of_an_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red orange yellow green blue indigo violet")
    rows = [(1, b, "x", "s", 1), (1, a, "y", "s", 2), (1, a, "y", "s", 2), (2, c, "x", "t", 3), (3, c, "x", "t", 3), (4, None, "x", "t", 0), (4, "", "x", "t", 0), (None, a, "x", "t", 1), (None, a, "x", "t", 1)]
    docs = spark.createDataFrame([(*r, "c", 7) for r in rows], DOCS + ", __id string, kept int")
    want = [(1, a, "y", "s", 2), (2, c, "x", "t", 3), (4, None, "x", "t", 0), (None, a, "x", "t", 1), (None, a, "x", "t", 1)]
    for order in (docs, docs.repartition(7), docs.orderBy("text")):
        got = corpus_pipeline.near_duplicate_stage(spark, order, "")
        assert got.columns == docs.columns and sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_passage_stage_on_null_and_empty_texts(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(1, "start " + passage, "x", "s", 9), (2, passage + " end of it", "x", "s", 9), (3, None, "x", "s", 0), (4, "", "x", "s", 0), (5, "short text", "x", "s", 9)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.passage_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got[1] == rows[0][1] and got[2].split()[-3:] == ["end", "of", "it"] and passage not in got[2]
    assert (got[3], got[4], got[5]) == (None, "", "short text")
