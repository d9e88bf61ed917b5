"""Requests per client, route and minute against the route's limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: requests per minute ----------------------------------------------------
ROUTE_LIMITS = {
    "papers POST": 10,
    "papers GET": 60,
    "sessions GET": 60,
    "sessions POST": 20,
    "sessions PATCH": 20,
    "messages POST": 30,
    "messages GET": 60,
}
# -----------------------------------------------------------------------------------------


def rate_windows(
    requests: DataFrame, limits: dict[str, int] = ROUTE_LIMITS, delay: str | None = None,
) -> DataFrame:
    """``client_id, route, minute, n, over_limit``; routes without a limit are never over.

    With ``delay`` this is a streaming aggregate that drops later requests.
    """
    timed = requests if delay is None else requests.withWatermark("ts", delay)
    allowed = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    counted = timed.groupBy("client_id", "route", F.window("ts", "1 minute").alias("_w")).agg(
        F.count("*").alias("n"))
    return counted.select("client_id", "route", F.col("_w.start").alias("minute"), "n",
                          F.coalesce(F.col("n") > allowed[F.col("route")], F.lit(False)).alias("over_limit"))


def stream_rate_limits(
    requests: DataFrame, limits: dict[str, int] = ROUTE_LIMITS, delay: str = "2 minutes",
) -> DataFrame:
    return rate_windows(requests, limits, delay)
