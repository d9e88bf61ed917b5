"""Retrieval metrics, grading metrics, attribution, baselines and latency totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrag.functions.rules import GRADE_HIGH, GRADE_LOW
from corrag.functions.text import sentences, strip_ws
from corrag.operators.blockmatch import pack_blocks, pair_blocks
from corrag.operators.embedding import embed
from corrag.operators.topk import first_per_key, top_k
from corrag.session import staged

CUTOFF = 5
ATTRIBUTION_THRESHOLD = 0.75
TOLERANCE = 0.05


def build_run(hits: DataFrame, name: str, item: str = "chunk_id") -> DataFrame:
    """A named run; an item found several times counts with its best score."""
    return hits.groupBy("query_id", F.col(item).cast("string").alias("chunk_id")).agg(
        F.max(F.col("score").cast("double")).alias("score")).select(
        F.lit(name).alias("run_name"), "query_id", "chunk_id", "score")


def _judged(qrels: DataFrame, runs: DataFrame) -> DataFrame:
    return runs.join(qrels.filter(F.col("relevance") > 0), ["query_id", "chunk_id"])


def recall_at_k(qrels: DataFrame, runs: DataFrame, k: int = CUTOFF) -> DataFrame:
    """``run_name, query_id, value``: relevant items in the top ``k`` over all relevant."""
    top = top_k(runs, ["run_name", "query_id"], [F.desc("score"), F.asc("chunk_id")], k)
    found = _judged(qrels, top).groupBy("run_name", "query_id").agg(F.count("*").alias("_found"))
    return _query_runs(qrels, runs).join(found, ["run_name", "query_id"], "left").select(
        "run_name", "query_id",
        (F.coalesce("_found", F.lit(0)) / F.col("n_relevant")).alias("value"))


def _query_runs(qrels: DataFrame, runs: DataFrame) -> DataFrame:
    """Every judged query under every run name, so that a missing query scores 0."""
    per_query = qrels.filter(F.col("relevance") > 0).groupBy("query_id").agg(
        F.count("*").alias("n_relevant"))
    return per_query.withColumn("run_name", F.explode(
        runs.agg(F.collect_set("run_name").alias("names")).scalar()))


def ndcg_at_k(qrels: DataFrame, runs: DataFrame, k: int = CUTOFF) -> DataFrame:
    """Discounted gain over the ideal order (Järvelin & Kekäläinen, 2002)."""
    def gain(rank: Column) -> Column:
        return F.sum(F.col("relevance") / F.log2(rank + 1))

    top = top_k(runs, ["run_name", "query_id"], [F.desc("score"), F.asc("chunk_id")], k)
    actual = _judged(qrels, top).groupBy("run_name", "query_id").agg(gain(F.col("rank")).alias("_dcg"))
    ideal = top_k(qrels.filter(F.col("relevance") > 0), ["query_id"],
                  [F.desc("relevance"), F.asc("chunk_id")], k).groupBy("query_id").agg(
        gain(F.col("rank")).alias("_ideal"))
    return (_query_runs(qrels, runs).join(ideal, "query_id")
            .join(actual, ["run_name", "query_id"], "left").select(
                "run_name", "query_id",
                (F.coalesce("_dcg", F.lit(0.0)) / F.col("_ideal")).alias("value")))


def mrr(qrels: DataFrame, runs: DataFrame) -> DataFrame:
    """Reciprocal rank of the first relevant item, no cutoff.

    The rank is one plus the number of items ahead of it, which is a plain count: no run has
    to be sorted, however long it is.
    """
    keys = ["run_name", "query_id"]
    best = _judged(qrels, runs).groupBy(*keys).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "chunk_id")).alias("_best"))
    ahead = runs.join(best, keys).groupBy(*keys).agg(F.count_if(
        F.struct((-F.col("score")).alias("minus"), "chunk_id") < F.col("_best")).alias("_ahead"))
    return _query_runs(qrels, runs).join(ahead, keys, "left").select(
        *keys, F.coalesce(1.0 / (F.col("_ahead") + 1), F.lit(0.0)).alias("value"))


def mrr_of_ranks(qrels: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """``mrr`` from the ranks of judged items (``query_id, chunk_id, rank``), without any run."""
    best = _judged(qrels, ranks).groupBy("query_id").agg(F.min("rank").alias("_rank"))
    asked = qrels.filter(F.col("relevance") > 0).select("query_id").distinct()
    return asked.join(best, "query_id", "left").select(
        F.lit(name).alias("run_name"), "query_id", F.coalesce(1.0 / F.col("_rank"), F.lit(0.0)).alias("value"))


def comparison_report(qrels: DataFrame, runs: DataFrame, k: int = CUTOFF) -> DataFrame:
    """``run_name, metric, value`` averaged over all judged queries."""
    parts = [(f"recall@{k}", recall_at_k(qrels, runs, k)), (f"ndcg@{k}", ndcg_at_k(qrels, runs, k)),
             ("mrr", mrr(qrels, runs))]
    report = None
    for name, values in parts:
        part = values.withColumn("metric", F.lit(name))
        report = part if report is None else report.unionByName(part)
    return report.groupBy("run_name", "metric").agg(F.round(F.avg("value"), 6).alias("value"))


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def grading_metrics(pairs: DataFrame) -> DataFrame:
    """``metric, value`` from boolean ``predicted`` and ``label``."""
    p, a = F.coalesce("predicted", F.lit(False)), F.coalesce("label", F.lit(False))
    counts = pairs.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"),
                       F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(F.explode(F.array(*(
        F.struct(F.lit(name).alias("metric"), F.round(value, 6).alias("value"))
        for name, value in (("accuracy", _ratio(tp + tn, tp + fp + fn + tn)),
                            ("fnr", _ratio(fn, fn + tp)), ("fpr", _ratio(fp, fp + tn)))))
    ).alias("m")).select("m.metric", "m.value")


def score_histogram(scores: DataFrame, col: str = "score", bins: int = 20) -> DataFrame:
    """``bin, lower, upper, n`` over equal bins between the smallest and largest score."""
    known = scores.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_s"))
    range_ = known.agg(F.struct(F.min("_s").alias("lo"), F.max("_s").alias("hi")).alias("r"))
    spread = known.withColumn("_r", range_.scalar())
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_s") - F.col("_r.lo")) / width), F.lit(bins - 1)))
    counted = spread.groupBy(place.cast("int").alias("bin"), "_r").agg(F.count("*").alias("n"))
    return counted.select(
        "bin", F.round(F.col("_r.lo") + F.col("bin") * width, 6).alias("lower"),
        F.round(F.col("_r.lo") + (F.col("bin") + 1) * width, 6).alias("upper"), "n")


def score_bands(scores: DataFrame, col: str = "score", high: float = GRADE_HIGH, low: float = GRADE_LOW) -> DataFrame:
    s = F.col(col)
    return scores.filter(s.isNotNull()).groupBy(
        F.when(s >= high, F.lit("high")).when(s <= low, F.lit("low")).otherwise("between")
        .alias("band")).agg(F.count("*").alias("n"))


def attribute_answers(
    answers: DataFrame, chunks: DataFrame, threshold: float = ATTRIBUTION_THRESHOLD,
    embedder: Callable | None = None, dim: int = 256,
) -> DataFrame:
    """Per answer: attribution rate, sentences without a source, share of chunks used.

    ``answers``: ``answer_id, answer``. ``chunks``: ``answer_id, chunk_id, text`` with ids that
    sort in the given order. Each sentence takes its most similar chunk (ties: the earlier),
    if the similarity is positive and reaches ``threshold``. A blank answer is flagged.
    """
    blank = strip_ws(F.coalesce(F.col("answer"), F.lit(""))) == ""
    split = answers.select("answer_id", F.posexplode_outer(sentences(F.col("answer"))).alias(
        "at", "sentence")).filter(F.col("sentence").isNotNull())

    def keyed(df: DataFrame, id_: str, vector: str) -> DataFrame:
        return df.select(F.col("answer_id").alias("key"), F.col(id_).alias("id"), F.col(vector).alias("vector"))

    left = keyed(embed(split, "sentence", embedder, dim=dim, out="v"), "at", "v")
    right = keyed(embed(chunks, "text", embedder, dim=dim, out="v"), "chunk_id", "v")
    pairs = pair_blocks(pack_blocks(left), pack_blocks(right), 1)
    best = first_per_key(pairs, ["key", "left_id"], [F.desc("score"), F.asc("right_id")]).filter(
        (F.col("score") > 0) & (F.col("score") >= threshold))
    # Staged: two results below read it, and it is at most one row per sentence.
    sourced = staged(best.select(F.col("key").alias("answer_id"), F.col("left_id").alias("at"),
                                 F.col("right_id").alias("chunk_id")), "sourced")
    used = sourced.select("answer_id", "chunk_id").distinct().groupBy("answer_id").agg(
        F.count("*").alias("_used"))
    given = chunks.groupBy("answer_id").agg(F.count("*").alias("_given"))
    judged = split.join(sourced, ["answer_id", "at"], "left").groupBy("answer_id").agg(
        F.count("*").alias("n_sentences"), F.count("chunk_id").alias("_sourced"),
        F.transform(F.array_sort(F.collect_list(F.when(
            F.col("chunk_id").isNull(), F.struct("at", "sentence")))), lambda s: s["sentence"])
        .alias("unattributed_sentences"))
    return (answers.select("answer_id", blank.alias("blank_answer"))
            .join(judged, "answer_id", "left").join(used, "answer_id", "left")
            .join(given, "answer_id", "left").select(
        "answer_id", "blank_answer", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"),
        F.round(_ratio(F.coalesce("_sourced", F.lit(0)), F.coalesce("n_sentences", F.lit(0))), 6)
        .alias("attribution_rate"),
        F.coalesce("unattributed_sentences", F.array().cast("array<string>")).alias("unattributed_sentences"),
        F.round(_ratio(F.coalesce("_used", F.lit(0)), F.coalesce("_given", F.lit(0))), 6)
        .alias("chunk_utilization_rate")))


def attribution_averages(attributed: DataFrame) -> DataFrame:
    """``metric, value`` over the answers that are not blank; 0 without any."""
    means = attributed.filter(~F.col("blank_answer")).agg(
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
          for c in ("attribution_rate", "chunk_utilization_rate")))
    return means.select(F.explode(F.array(*(
        F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 6).alias("value")) for c in means.columns)))
        .alias("m")).select("m.metric", "m.value")


def score_sheet(grading: DataFrame, judged: DataFrame, attribution: DataFrame) -> DataFrame:
    """One ``metric, value`` table; ``judged`` holds one row per scored answer and metric."""
    generation = judged.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))
    return grading.select("metric", "value").unionByName(generation).unionByName(
        attribution.select("metric", "value"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Metrics that fell below the baseline by more than ``tolerance``."""
    keys = [c for c in ("paper_id", "metric") if c in current.columns and c in baseline.columns]
    now = current.select(*keys, F.col("value").alias("current"))
    before = baseline.select(*keys, F.col("value").alias("baseline"))
    return now.join(before, keys).filter(F.col("current") < F.col("baseline") - tolerance)


def latency_report(stage_events: DataFrame, call_events: DataFrame) -> DataFrame:
    """``kind, name, value``: seconds per stage (repeats add up), calls per provider."""
    stages = stage_events.groupBy(F.col("stage").alias("name")).agg(F.sum("seconds").alias("value"))
    calls = call_events.groupBy(F.col("provider").alias("name")).agg(
        F.count("*").cast("double").alias("value"))
    return stages.select(F.lit("stage").alias("kind"), "name", F.round("value", 6).alias("value")).unionByName(
        calls.select(F.lit("calls").alias("kind"), "name", "value"))
