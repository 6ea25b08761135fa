"""Thin queries over the ten operators, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.llm import bpe, brown, chains, hilbert, langid, mixing, oddsketch, onebit, quality, ranges, rmq, rotate, suffixes
from screenforge.llm.text import remainder, short_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Wanted token shares of the graded domains; the good ones are used once.
TARGETS = {"good": 0.88, "poor": 0.1, "toxic": 0.02}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text, read where the driver runs; about 1.5 MB, so tasks get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the label rows: toxic, poor or good."""
    g = quality.grade(F.col("quality"), F.col("toxic"))
    return labels.select("doc_id", F.when(g == 0, "toxic").when(g == 1, "poor").when(g == 2, "good").alias("domain"))


def languages(learn: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of ``docs`` by a model of ``learn`` (doc_id, text, lang)."""
    pieces = langid.public_pieces(tokenizer_json())
    return langid.predict(docs, *langid.fit(learn, pieces), pieces)


@query
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    return quality.graded(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = languages(docs.where(~held_out & F.col("doc_id").isNotNull()), docs)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_words")


@query
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found, names = mixing.mixed(table(spark, sf, "documents"), domains(table(spark, sf, "labels")), TARGETS)
    return found.select("doc_id", "n_tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(names)], "rate", "residual")


@query
def op4_brown(spark: SparkSession, sf: str) -> DataFrame:
    return brown.scored(table(spark, sf, "documents"))


@query
def op5_chains(spark: SparkSession, sf: str) -> DataFrame:
    return chains.passages(table(spark, sf, "documents"))


@query
def op6_odd_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf, "documents"), size=2)


@query
def op7_perspectives(spark: SparkSession, sf: str) -> DataFrame:
    return rotate.perspectives(table(spark, sf, "conversations")).withColumn("mask", F.to_json("mask"))


@query
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    spec = tokenizer_json()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf, "documents"), spec), spec))


@query
def op9_range_join(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.near_vectors(table(spark, sf, "embeddings"))


@query
def op10_one_bit(spark: SparkSession, sf: str) -> DataFrame:
    return onebit.search(table(spark, sf, "embeddings"))


_FOLD = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query
def op11_range_maximum(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    return rmq.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op11_range_maximum"] = f"""
WITH held AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERMS}') AS t FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, t, len(t) AS n FROM held WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (row), total GROUP BY ALL
),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query
def op12_difference_cover(spark: SparkSession, sf: str) -> DataFrame:
    short_batches(spark)
    found = suffixes.repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_hilbert_blocks(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hilbert.mine(table(spark, sf, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


SQL["op13_hilbert_blocks"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""
