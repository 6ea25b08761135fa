"""Mixing documents to target token weights of soft domains. DataFrame functions only.

A naive Bayes model of labelled documents gives every document a posterior over domains. A rate of
at least 0 per document is then fitted by projected gradient steps on the least squares between the
expected token totals of the domains and their targets. What reaches the driver per step is one
number per domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.llm.text import sampled
from screenforge.session import checkpointed

#: Hashed word buckets of the classifier and labelled documents it learns from (expected, by hash).
BUCKETS, FIT_DOCS = 1 << 15, 20_000
#: Steps without progress after which the targets count as out of reach.
PATIENCE = 50


def _tokens(docs: DataFrame, *carried: str) -> DataFrame:
    """One row per word, with its bucket; a text without words gives one row with a null bucket."""
    found = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(*carried, F.explode_outer(found).alias("__w")).select(*carried, F.pmod(F.xxhash64("__w"), F.lit(BUCKETS)).cast("int").alias("__b"), F.col("__w").isNotNull().alias("__is"))


def domain_posteriors(docs: DataFrame, labelled: DataFrame, fit_docs: int = FIT_DOCS, smooth: float = 1.0) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p_0 .. p_K-1) per row of ``docs`` and the K domain names, sorted.

    ``labelled`` has doc_id and domain (null domains and ids are left out; an id labelled more than
    once takes its first domain by name). A text without words gets the domain priors. Only doc_id
    and text are read; repeated rows each get their row. Without labels K is 0.
    """
    known = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    names = sorted(r[0] for r in known.select("domain").distinct().collect())
    chosen = sampled(known, F.col("doc_id"), known.count(), fit_docs)
    # the chosen ids are at most about fit_docs short rows, so this broadcast is bounded
    fitted = _tokens(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "domain")
    counts = checkpointed(fitted.groupBy("domain", F.when(F.col("__is"), F.col("__b")).alias("__b")).agg(F.count(F.lit(1)).alias("n")))
    totals = {r["domain"]: r["n"] for r in counts.where("__b IS NOT NULL").groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    priors = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_fit = sum(priors.values())
    prior = [math.log((priors.get(d, 0) + 1) / (n_fit + len(names))) for d in names]

    def weight(d: str) -> Column:
        n = F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0))
        return F.log((n + smooth) / F.lit(totals.get(d, 0) + smooth * BUCKETS)) - math.log(smooth / (totals.get(d, 0) + smooth * BUCKETS))

    # at most BUCKETS rows of K doubles; a bucket that no labelled text has weighs as an unseen word
    table = checkpointed(counts.where("__b IS NOT NULL").groupBy("__b").agg(F.sum("n"), *[weight(d).alias(f"__s{i}") for i, d in enumerate(names)]).drop("sum(n)"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("__row"))
    unseen = [math.log(smooth / (totals.get(d, 0) + smooth * BUCKETS)) for d in names]
    sums = (
        _tokens(rows, "doc_id", "__row").join(F.broadcast(table), "__b", "left").groupBy("__row", "doc_id")
        .agg(F.sum(F.col("__is").cast("long")).alias("n_tokens"), *[F.sum(F.when(F.col("__is"), F.coalesce(f"__s{i}", F.lit(0.0)) + unseen[i]).otherwise(0.0)).alias(f"__s{i}") for i in range(len(names))])
    )
    if not names:
        return sums.select("doc_id", "n_tokens"), names
    logs = [F.col(f"__s{i}") + prior[i] for i in range(len(names))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    sums = sums.select("doc_id", "n_tokens", *[F.exp(x - top).alias(f"__e{i}") for i, x in enumerate(logs)])
    whole = sum((F.col(f"__e{i}") for i in range(1, len(names))), F.col("__e0"))
    return sums.select("doc_id", "n_tokens", *[(F.col(f"__e{i}") / whole).alias(f"p_{i}") for i in range(len(names))]), names


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], total: float | str | None = None, rounds: int | None = None, close: float = 1e-4) -> DataFrame:
    """``members`` (n_tokens, p_0 ..) with ``rate`` >= 0 so that sum(n_tokens * rate * p_k) meets target_k * total.

    ``residual`` is the largest excess or lack of a domain at these rates, as a share of the total
    wanted (null where nothing can be fitted). Steps go on until it is at most ``close``. Without
    ``rounds`` they also end when it has not fallen by a hundredth in ``PATIENCE`` steps (targets
    that no rates meet), with it after so many steps.

    ``targets`` are weights over domain names, scaled to sum 1; a domain not named has target 0.
    ``total`` is the wanted number of tokens: the present one if None, or, if it names a domain,
    the total at which that domain is used once. All rates start at 1; a step is
    ``rate <- max(0, rate - p . g)`` with g_k the domain's excess over its present tokens. In this
    scaling the Hessian is similar to a stochastic matrix, so steps of 1 never diverge. Domains
    without tokens cannot be met. Rows without words keep rate 1 unless the steps lower it.
    Raises if targets name no known domain with a positive weight.
    """
    state = checkpointed(members.withColumn("rate", F.lit(1.0)))
    sums = [F.sum(F.col("n_tokens") * F.col(f"p_{i}") * F.col("rate")).alias(f"s{i}") for i in range(len(names))]
    have = [float(x or 0.0) for x in state.agg(*sums).first()] if names else []
    weights = [max(0.0, float(targets.get(d, 0.0))) for d in names]
    if not any(h > 0 for h in have):
        return state.withColumn("residual", F.lit(None).cast("double"))
    if not sum(weights):
        raise ValueError(f"no target for any of the domains {names}")
    share = [w / sum(weights) for w in weights]
    if isinstance(total, str):
        k = names.index(total)
        total = have[k] / share[k]
    goal = [s * (sum(have) if total is None else total) for s in share]
    excess = lambda now: max(abs(a - g) for a, g, h in zip(now, goal, have, strict=True) if h > 0) / sum(goal)
    now, steps, best, since = have, 0, math.inf, 0
    while True:
        residual = excess(now)
        since = 0 if residual < 0.99 * best else since + 1
        best = min(best, residual)
        if residual <= close or (since >= PATIENCE if rounds is None else steps >= rounds):
            break
        gap = [(a - g) / h if h > 0 else 0.0 for a, g, h in zip(now, goal, have, strict=True)]
        move = sum((F.col(f"p_{i}") * gap[i] for i in range(1, len(names))), F.col("p_0") * gap[0])
        state = state.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
        steps += 1
        if steps % 8 == 0:
            state = checkpointed(state)
        now = [float(x or 0.0) for x in state.agg(*sums).first()]
    return state.withColumn("residual", F.lit(residual))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | str | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, n_tokens, p_k .., rate, residual) per document and the domain names."""
    members, names = domain_posteriors(docs, labelled)
    return fit_rates(members, names, targets, total), names


def copies(rate: Column, doc_id: Column, seed: int = 5) -> Column:
    """Whole number of uses with mean ``rate``: its whole part, plus one with the chance of the rest, drawn by hash."""
    u = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")
