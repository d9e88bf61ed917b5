"""Mixing to target weights with soft domain membership, in DataFrame and SQL functions only.

1. A classifier learns from a labelled table: naive Bayes over hashed words, where a bucket counts
   only if some domain has it twice as often as chance and ``MIN_Z`` standard deviations above it, so
   that the many rare words of a text add no noise. It gives each document a posterior over the domains.
2. Projected-gradient least squares finds document rates ``r >= 0`` whose expected domain totals
   ``sum(r * tokens * posterior)`` match the targets. Each step is one distributed sum of D + D * D
   numbers and a column update ``r := max(0, r - posterior . slopes)``. The slopes are the residuals in
   the metric of the moment matrix of the documents whose rate is not yet 0, for D domains.

Defined results: null text and text without words has 0 tokens, the prior as posterior and a rate
like any other. Without labelled rows, or with one domain, every rate is the ratio of target to
total. A domain without weight in ``targets`` gets target 0; targets need not sum to 1. Equal texts
get equal posteriors and rates. Tables may be empty. Documents labelled more than once count for
each label.
"""

from __future__ import annotations

from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import read_table
from corrag.session import staged

#: Buckets that words hash to.
BUCKETS = 1 << 15
#: Buckets and the places of the three made-up words.
FEATURES = BUCKETS + 36
MIN_Z = 5.0
#: Steps between two written states, which keep the rate's expression short.
ROUND = 8
MAX_STEPS = 48
#: Largest relative miss of a domain total at which the fit ends.
TOLERANCE = 1e-3
#: Shares of the tokens that the mixture shall have, by domain.
TARGETS = {"high": 0.93, "low": 0.06, "toxic": 0.01}


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``_features``, the distinct buckets of the text.

    Tokens are runs of letters and digits, lowered. Features are the tokens, and one made-up word each
    for the share of symbols, of capitals and of distinct tokens.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Everything in ASCII that is no letter or digit parts words.
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    rows = docs.withColumns({
        "_hashes": F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int")),
        "_length": F.length(text),
        "_marks": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]+", "")),
        "_capitals": F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]+", ""))})
    rows = rows.withColumns({"n_tokens": F.size("_hashes").cast("long"), "_distinct": F.array_distinct("_hashes")}).drop("_hashes")

    def grade(place, part, whole):  # tenths, and a place for texts without any
        step = F.coalesce(F.floor(F.try_divide(part * 10, whole)), F.lit(11))
        return (F.lit(BUCKETS + 12 * place) + step).cast("int")

    made_up = F.array(grade(0, F.col("_marks"), F.col("_length")), grade(1, F.col("_capitals"), F.col("_length")),
                      grade(2, F.size("_distinct"), F.col("n_tokens")))
    return rows.withColumn("_features", F.array_union("_distinct", made_up)).drop("_distinct", "_marks", "_capitals", "_length")


def fit_domains(labelled: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """Per domain its log score of a text without features, and what each bucket adds to it.

    Bernoulli naive Bayes over the buckets that stand out in some domain. ``labelled`` has ``_features``
    and ``domain``. What reaches the driver is at most domains x FEATURES counts.
    """
    texts = dict(labelled.groupBy("domain").count().collect())
    counts = (labelled.select("domain", F.explode("_features").alias("bucket"))
              .groupBy("domain", "bucket").count().collect())
    total = sum(texts.values())
    overall, own, mass = [0] * FEATURES, {d: [0] * FEATURES for d in domains}, dict.fromkeys(domains, 0)
    for d, b, n in counts:
        own[d][b] = n
        mass[d] += n
        overall[b] += n
    whole = sum(mass.values())

    def stands_out(d, b):
        expected = overall[b] * mass[d] / whole if whole else 0
        return own[d][b] > 2 * expected and own[d][b] - expected > MIN_Z * sqrt(expected) + 1

    chosen = [b for b in range(FEATURES) if overall[b] and any(stands_out(d, b) for d in domains)]
    bases, weights = [], []
    for d in domains:
        n, base, line = texts.get(d, 0), log((texts.get(d, 0) + 0.5) / (total + 0.5 * len(domains))), [0.0] * FEATURES
        for b in chosen:
            rate = (own[d][b] + 0.5) / (n + 1)
            base += log(1 - rate)
            line[b] = log(rate) - log(1 - rate)
        bases.append(base)
        weights.append(line)
    return bases, weights


def posteriors(docs: DataFrame, bases, weights) -> DataFrame:
    """``docs`` (with ``_features``) with ``posterior``, an array in the order of ``domains``."""
    def log_score(base, line):
        table = F.split(F.lit(",".join(map(repr, line))), ",").cast("array<double>")  # folded to one literal
        return F.lit(base) + F.aggregate("_features", F.lit(0.0), lambda total, b: total + F.get(table, b))

    rows = docs.withColumn("_logs", F.array(*map(log_score, bases, weights)))
    rows = rows.withColumn("_e", F.expr("transform(_logs, x -> exp(x - array_max(_logs)))"))
    return rows.withColumn("posterior", F.expr(
        "transform(_e, x -> x / aggregate(_e, 0D, (a, y) -> a + y))")).drop("_features", "_logs", "_e")


def fit_rates(soft: DataFrame, targets: list[float]) -> DataFrame:
    """``soft`` (``n_tokens``, ``posterior``) with ``rate``; targets are token totals by domain."""
    size = len(targets)
    p = [F.get("posterior", F.lit(d)) for d in range(size)]
    tokens = F.col("n_tokens").cast("double")

    def measure(rows, rate):
        """Domain totals at these rates, and the moment matrix of the documents that can still go down."""
        totals = [F.sum(tokens * x * rate) for x in p]
        moments = [F.sum(F.when(rate > 0, tokens * x * y)) for x in p for y in p]
        found = rows.agg(*(F.coalesce(x, F.lit(0.0)) for x in totals + moments)).first()
        return list(found[:size]), found[size:]

    state, rate = soft.withColumn("rate", F.lit(1.0)), F.col("rate")
    totals, moments = measure(state, rate)
    reachable = np.array(totals) > 0
    for step in range(MAX_STEPS):
        miss = np.where(reachable, np.subtract(totals, targets), 0.0)
        if (np.abs(miss) <= TOLERANCE * np.maximum(targets, 1.0)).all():
            break
        # The gradient's metric is the moment matrix of the documents still free, D x D.
        metric = np.reshape(moments, (size, size))
        slopes = np.linalg.lstsq(metric + 1e-9 * np.trace(metric) * np.eye(size), miss, rcond=None)[0]
        rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(float(s)) for x, s in zip(p, slopes)), F.lit(0.0)))
        if step % ROUND == ROUND - 1:
            state = staged(state.withColumn("rate", rate), "rates")
            rate = F.col("rate")
        totals, moments = measure(state, rate)
    return state.withColumn("rate", rate)


def label_domain(quality, toxic):
    """Column: the domain that a row of the labels table names."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, total_tokens: float | None = None,
                  anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, posterior, rate, copies, and ``row_col`` if given.

    ``labelled`` has the id and ``domain``. The mixture has ``total_tokens``, by default as many as the
    corpus; with ``anchor`` instead that many that this domain keeps its natural total. ``copies`` is
    the rate rounded up or down by a hash of the id, so that its mean is the rate; where the id is null, of
    ``row_col``, a number of the row.
    """
    domains = sorted(targets)
    known = labelled.filter(F.col("domain").isin(domains)).select(F.col(id_col).alias("_id"), "domain")
    slim = staged(with_features(docs.select(F.col(id_col).alias("_id"), F.col(text_col), *([row_col] if row_col else [])), text_col).drop(text_col), "features")
    bases, weights = fit_domains(slim.join(known.hint("merge"), "_id"), domains)
    soft = staged(posteriors(slim, bases, weights), "posteriors")
    natural = soft.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), *(
        F.coalesce(F.sum(F.col("n_tokens") * F.get("posterior", F.lit(d))), F.lit(0.0))
        for d in range(len(domains)))).first()
    whole = float(natural[0]) if total_tokens is None else float(total_tokens)
    weight = sum(targets.values())
    if anchor is not None:
        whole = natural[1 + domains.index(anchor)] * weight / targets[anchor]
    rated = fit_rates(soft, [whole * targets[d] / weight for d in domains])
    drawn = F.coalesce(F.col("_id").cast("long"), F.col(row_col)) if row_col else F.col("_id")
    chance = F.pmod(F.xxhash64(drawn, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("long")).withColumnRenamed("_id", id_col)


def query_mixing(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    mixed = mix_documents(read_table(spark, sf_dir, "documents"), labelled)
    return mixed.select("doc_id", "n_tokens", *(
        F.get("posterior", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(sorted(TARGETS))), "rate", "copies")
