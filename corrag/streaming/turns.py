"""Live event log to finished turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.operators.sessions import ERROR_MESSAGE, RATE_LIMIT_MESSAGE


def stream_turns(events: DataFrame, delay: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """One row per turn, sent once no more of its events can arrive.

    A session window keeps a turn whole wherever it falls; a fixed window would cut it at its
    edge. Events later than ``delay`` are dropped. The same rules as ``assemble_turns``.
    """
    is_ = {kind: F.col("type") == kind for kind in ("token", "done", "error", "citation")}

    def in_order(value):
        return F.transform(F.array_sort(value), lambda s: s["v"])

    def listed(kind, value):
        return F.collect_list(F.when(is_[kind], F.struct("seq", F.coalesce(value, F.lit("")).alias("v"))))

    grouped = (events.withWatermark("ts", delay)
               .groupBy("session_id", "turn_id", F.session_window("ts", gap).alias("_w"))
               .agg(listed("token", F.col("content")).alias("_tokens"),
                    listed("citation", F.col("arxiv_id")).alias("_cited"),
                    F.max(F.when(is_["done"], F.struct("seq", "content"))).alias("_done"),
                    F.max(F.when(is_["error"], F.col("content") == "rate_limited")).alias("_limited")))
    text = F.array_join(in_order(F.col("_tokens")), "")
    finished = grouped.filter(F.col("_done").isNotNull() | F.col("_limited").isNotNull())
    return finished.select(
        "session_id", "turn_id", F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"),
        F.when(F.col("_done").isNotNull(), F.coalesce("_done.content", text))
        .when(F.col("_limited"), F.lit(RATE_LIMIT_MESSAGE)).otherwise(F.lit(ERROR_MESSAGE)).alias("content"),
        F.when(F.col("_done").isNotNull(), in_order(F.col("_cited")))
        .otherwise(F.array().cast("array<string>")).alias("cited"))
