"""Session tables: titles, listings, history, and turns assembled from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrag.functions.text import strip_ws
from corrag.operators.topk import joined_in_order, top_k

LIST_LIMIT, TITLE_CHARS = 50, 60
ERROR_MESSAGE = "⚠️ This question could not be answered; something failed on the way."
RATE_LIMIT_MESSAGE = (
    "⚠️ Too many requests at the moment; this question can be asked again shortly.")


def session_title(title: Column, first_message: Column, mode: Column, paper_id: Column) -> Column:
    line = F.replace(strip_ws(first_message), F.lit("\n"), F.lit(" "))
    short = F.concat(F.substring(line, 1, TITLE_CHARS),
                     F.when(F.length(line) > TITLE_CHARS, F.lit("…")).otherwise(""))
    return (F.when(F.coalesce(title, F.lit("")) != "", title)
            .when(F.coalesce(first_message, F.lit("")) != "", short)
            .when((mode == "deep_dive") & (F.coalesce(paper_id, F.lit("")) != ""),
                  F.concat(F.lit("Deep Dive · "), paper_id))
            .otherwise(F.lit("New chat")))


def sessions_for_client(sessions: DataFrame, client_id: str | None) -> DataFrame:
    """Listing is strict: without a client id there is nothing to list."""
    if client_id is None:
        return sessions.limit(0)
    return sessions.filter(F.col("client_id") == client_id)


def session_visible(owner: Column, client_id: str | None) -> Column:
    """Opening one session is lenient: sessions without an owner are open to all."""
    return owner.isNull() | F.coalesce(owner == F.lit(client_id), F.lit(False))


def list_sessions(
    sessions: DataFrame, messages: DataFrame, client_id: str | None = None,
    every_client: bool = False, limit: int = LIST_LIMIT,
) -> DataFrame:
    """The newest sessions with their titles, for one client or for each client at once.

    Sessions are cut to ``limit`` per client before the messages are read, and the first user
    message is a combining aggregate, so a long session costs no sort.
    """
    mine = (sessions.filter(F.col("client_id").isNotNull()) if every_client
            else sessions_for_client(sessions, client_id))
    recent = top_k(mine, ["client_id"], [F.desc("created_at"), F.asc("session_id")], limit, "position")
    first = (messages.filter(F.col("role") == "user")
             .join(recent.select("session_id"), "session_id", "left_semi")
             .groupBy("session_id").agg(F.min_by("content", "turn").alias("_first")))
    return recent.join(first, "session_id", "left").select(
        "client_id", "position", "session_id", "mode", "paper_id", "created_at",
        session_title(F.col("title"), F.col("_first"), F.col("mode"), F.col("paper_id")).alias("title"))


def chat_history(messages: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Messages before the current turn of each session (one turn per session in
    ``current``); the whole transcript without one. Rows are ordered by ``turn``."""
    columns = ("session_id", "turn", "role", "content")
    if current is None:
        return messages.select(*columns)
    now = current.select("session_id", F.col("turn").alias("_now"))
    return messages.join(now, "session_id").filter(F.col("turn") < F.col("_now")).select(*columns)


def deep_dive_ready(sessions: DataFrame, papers: DataFrame) -> DataFrame:
    """Ask sessions are always ready; deep dives need their paper ingested."""
    status = papers.select("paper_id", "ingestion_status")
    return sessions.join(status, "paper_id", "left").withColumn("ready", F.when(
        F.col("mode") == "deep_dive",
        F.coalesce(F.col("ingestion_status").isin("full", "abstract_only"), F.lit(False)))
        .otherwise(F.lit(True))).drop("ingestion_status")


def assemble_turns(events: DataFrame, keys: tuple[str, ...] = ("session_id", "turn_id")):
    """Event log to ``(messages, cited)``.

    Tokens are joined by ``seq``; ``done.content`` replaces them; a turn without ``done``
    yields nothing unless it ended in an error, which leaves a placeholder message.
    """
    keys = list(keys)
    text = joined_in_order(
        events.filter(F.col("type") == "token").withColumn("content", F.coalesce("content", F.lit(""))),
        keys, "seq", "content", "", out="_tokens")
    ends = events.filter(F.col("type").isin("done", "error")).groupBy(*keys).agg(
        F.max(F.col("type") == "done").alias("_done"),
        F.max_by(F.when(F.col("type") == "done", F.col("content")),
                 F.when(F.col("type") == "done", F.col("seq"))).alias("_final"),
        F.max(F.when(F.col("type") == "error", F.col("content") == "rate_limited")).alias("_limited"))
    message_id = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    finished = ends.join(text, keys, "left")
    messages = finished.select(
        *keys, message_id.alias("message_id"), F.lit("assistant").alias("role"),
        F.when(F.col("_done"), F.coalesce("_final", "_tokens", F.lit("")))
        .when(F.col("_limited"), F.lit(RATE_LIMIT_MESSAGE))
        .otherwise(F.lit(ERROR_MESSAGE)).alias("content"))
    cited = (events.filter(F.col("type") == "citation")
             .join(ends.filter(F.col("_done")).select(*keys), keys, "left_semi")
             .select(*keys, message_id.alias("message_id"), "seq",
                     F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), "title", "abstract_snippet"))
    return messages, cited
