"""Streaming jobs run over everything available, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag import schemas
from corrag.catalog import tables
from corrag.catalog.ingest import PAGE_CHUNKS
from corrag.catalog.dialogue import turn_events
from corrag.catalog.registry import query
from corrag.session import new_shared_path
from corrag.sources.tablelog import read_table
from corrag.streaming.common import append_to, stream_parquet
from corrag.streaming.ingest import stream_ingest
from corrag.streaming.limits import rate_windows, stream_rate_limits
from corrag.streaming.turns import stream_turns

_LIMITS = {"click": 1, "view": 2, "error": 0}

_MINUTES = """w AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS client_id, event_type AS route, time_bucket(INTERVAL 1 MINUTE, ts) AS minute,
         count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT client_id, route, minute, epoch(minute)::BIGINT AS minute_s, n,
    CASE route WHEN 'click' THEN n > 1 WHEN 'view' THEN n > 2 WHEN 'error' THEN n > 0 ELSE FALSE END AS over_limit FROM w)"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 10).cast("string").alias("client_id"),
                         F.col("event_type").alias("route"), F.col("ts").cast("timestamp").alias("ts"))


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream_parquet(spark, f"{sf}/events.parquet", tables.read(spark, sf, "events").schema)


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = new_shared_path(spark, name)
    append_to(stream, path, f"{path}-checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("rate_windows", f"WITH {_MINUTES} SELECT client_id, route, minute_s, n, over_limit FROM r")
def rate_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    return rate_windows(_requests(tables.read(spark, sf, "events")), _LIMITS).select(
        "client_id", "route", F.unix_seconds("minute").alias("minute_s"), "n", "over_limit")


@query("stream_rate_limits", f"""WITH {_MINUTES}
SELECT client_id, route, minute_s, n, over_limit FROM r
WHERE minute + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM events)""")
def stream_rate_limits_query(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts from a stream: the minutes that the watermark has closed."""
    out = _run(spark, stream_rate_limits(_requests(_events_stream(spark, sf)), _LIMITS), "limits")
    return out.select("client_id", "route", F.unix_seconds("minute").alias("minute_s"), "n", "over_limit")


@query("stream_turns", """WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS turn_id, event_id AS seq, ts,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'citation' ELSE 'token' END AS type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
te AS (SELECT *, CASE type WHEN 'token' THEN k || ' ' WHEN 'done' THEN CASE WHEN k % 2 = 1 THEN 'final ' || k END
    WHEN 'error' THEN CASE WHEN k < 50 THEN 'rate_limited' ELSE 'error' END END AS content FROM ev),
jumps AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 3 HOUR, TRUE) AS jump FROM te
  WINDOW w AS (PARTITION BY session_id, turn_id ORDER BY ts)),
runs AS (SELECT *, sum(jump::INT) OVER (PARTITION BY session_id, turn_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM jumps),
t AS (SELECT session_id, turn_id, run, max(ts) + INTERVAL 3 HOUR AS ended, bool_or(type = 'done') AS done,
    bool_or(type = 'error') AS failed, coalesce(bool_or(content = 'rate_limited') FILTER (type = 'error'), FALSE) AS limited,
    arg_max_null(content, seq) FILTER (type = 'done') AS final,
    coalesce(string_agg(content, '' ORDER BY seq) FILTER (type = 'token'), '') AS text,
    count(*) FILTER (type = 'citation') AS n FROM runs GROUP BY ALL)
SELECT session_id, turn_id, md5(CASE WHEN done THEN coalesce(final, text)
    WHEN limited THEN '⚠️ Too many requests at the moment; this question can be asked again shortly.'
    ELSE '⚠️ This question could not be answered; something failed on the way.' END) AS content_md5,
  CAST(CASE WHEN done THEN n ELSE 0 END AS INTEGER) AS n_cited
FROM t WHERE (done OR failed)
  AND ended <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_turns_query(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the event log as a stream, with a pause of three hours between turns."""
    out = _run(spark, stream_turns(turn_events(_events_stream(spark, sf)), gap="3 hours"), "turns")
    return out.select("session_id", "turn_id", F.md5("content").alias("content_md5"),
                      F.size("cited").alias("n_cited"))


@query("stream_ingest", f"""WITH {PAGE_CHUNKS}
SELECT paper_id, chunk_type, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM page_chunks GROUP BY ALL""")
def stream_ingest_query(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as a stream into a fresh store; chunk counts per paper."""
    pages = stream_parquet(spark, f"{sf}/pages.parquet", tables.read(spark, sf, "pages").schema).select(
        F.col("page_id").cast("string").alias("paper_id"), "html")
    path = new_shared_path(spark, "stream-ingest")
    stream_ingest(pages, path, f"{path}-checkpoint", root="article", buckets=16,
                  available_now=True).awaitTermination()
    return read_table(spark, path, "chunks", schemas.CHUNKS).groupBy("paper_id", "chunk_type").agg(
        F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))
