"""What a model call needs: budgeted context and history, messages, citations, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrag.functions.text import (
    Tokenizer, count_tokens, snippet, spaced_tokens, strip_ws, tokens, truncate_tokens)
from corrag.operators.topk import top_k

CONTEXT_TOKENS, HISTORY_TOKENS, MIN_SECTION_TOKENS = 6000, 1500, 200
MEDIA_ITEMS = 6
CONTEXT_OPEN, CONTEXT_CLOSE = "<retrieved_context>", "</retrieved_context>"


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def build_context(
    sections: DataFrame, budget: int = CONTEXT_TOKENS, min_tokens: int = MIN_SECTION_TOKENS,
    tokenizer: Tokenizer = tokens, splitter: Tokenizer = spaced_tokens,
) -> DataFrame:
    """``query_id, context, context_tokens, n_sections``.

    Whole labelled blocks while the running total fits, then the first that overflows cut to
    what is left if that is worth it. Blocks in which the tokenizer finds no token are left out;
    of the others a query never needs more than ``budget + 1``, so the rest is cut off before
    the shuffle.
    """
    source = F.when(_text("paper_title") != "", F.col("paper_title")).otherwise(_text("paper_id"))
    year = F.substring(_text("published_date"), 1, 4)
    label = F.concat(
        F.lit("[Source: "), source, F.when(year != "", F.concat(F.lit(", "), year)).otherwise(""),
        F.lit("]"), F.when(_text("section_title") != "", F.concat(
            F.lit(" ["), F.col("section_title"), F.lit("]"))).otherwise(""))
    labelled = sections.select("query_id", "rank", F.concat(label, F.lit("\n"), _text("text")).alias("_block"))
    counted = labelled.withColumn("_tokens", count_tokens(F.col("_block"), tokenizer))
    sized = top_k(counted.filter(F.col("_tokens") > 0), ["query_id"], [F.asc("rank")], budget + 1, "_row")
    running = Window.partitionBy("query_id").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized.withColumn("_used", F.sum("_tokens").over(running))
    left = F.lit(budget) - (F.col("_used") - F.col("_tokens"))
    pieces = summed.withColumn(
        "_piece", F.when(F.col("_used") <= budget, F.col("_block")).when(
            (left >= min_tokens), truncate_tokens(F.col("_block"), left.cast("int"), splitter)))
    pieces = pieces.filter(F.col("_piece").isNotNull()).withColumn(
        "_size", F.least(F.col("_tokens"), left))
    return pieces.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_piece"))),
                                 lambda s: s["_piece"]), "\n\n").alias("context"),
        F.sum("_size").cast("int").alias("context_tokens"),
        F.count("*").cast("int").alias("n_sections"))


def trim_history(
    messages: DataFrame, budget: int = HISTORY_TOKENS, key: str = "session_id",
    tokenizer: Tokenizer = tokens,
) -> DataFrame:
    """The latest messages whose total stays within ``budget``; order them by ``turn``.

    Only the newest ``budget + 1`` messages that have tokens can decide where the cut is, so
    a session of any length is summed over at most that many rows.
    """
    sized = messages.withColumn("_tokens", count_tokens(_text("content"), tokenizer))
    newest = top_k(sized.filter(F.col("_tokens") > 0).select(key, "turn", "_tokens"),
                   [key], [F.desc("turn")], budget + 1, "_row")
    running = Window.partitionBy(key).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    cut = (newest.withColumn("_used", F.sum("_tokens").over(running))
           .filter(F.col("_used") > budget).groupBy(key).agg(F.max("turn").alias("_cut")))
    return (sized.join(cut, key, "left")
            .filter(F.col("_cut").isNull() | (F.col("turn") > F.col("_cut")))
            .withColumnRenamed("_tokens", "tokens").drop("_cut"))


def assemble_prompts(
    queries: DataFrame, context: DataFrame, history: DataFrame, templates: dict[str, str],
    fence_note: str = "",
) -> DataFrame:
    """``query_id, messages``: system, trimmed history, user.

    ``templates`` holds the caller's system texts for ``chat``, ``clarify``, ``general``,
    ``ask`` and ``deep_dive``. Context is added for research turns only, inside a fence that
    marks it as data. ``history`` is trimmed: ``query_id, turn, role, content``.
    """
    kind = (F.when(F.col("intent").isin("chat", "clarify", "general"), F.col("intent"))
            .when(F.col("mode") == "deep_dive", F.lit("deep_dive")).otherwise(F.lit("ask")))
    texts = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    note = f"{fence_note}\n\n" if fence_note else ""
    fenced = F.concat(F.lit(f"\n\n{note}{CONTEXT_OPEN}\n"), F.col("context"), F.lit(f"\n{CONTEXT_CLOSE}"))
    wants = kind.isin("ask", "deep_dive") & (_text("context") != "")
    system = F.concat(F.coalesce(texts[kind], F.lit("")), F.when(wants, fenced).otherwise(""))

    def message(role, content):
        return F.struct(role.alias("role"), content.alias("content"))

    past = history.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
        lambda m: message(m["role"], m["content"])).alias("_past"))
    return (queries.join(context.select("query_id", "context"), "query_id", "left")
            .join(past, "query_id", "left")
            .select("query_id", F.concat(
                F.array(message(F.lit("system"), system)),
                F.coalesce("_past", F.array().cast("array<struct<role:string,content:string>>")),
                F.array(message(F.lit("user"), F.col("user_message")))).alias("messages")))


def citations(sections: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per cited paper in first-seen order; only research turns cite."""
    used = sections.filter(_text("paper_id") != "")
    if queries is not None:
        used = used.join(queries.filter(F.col("intent") == "research").select("query_id"),
                         "query_id", "left_semi")
    first = used.groupBy("query_id", "paper_id").agg(
        F.min(F.struct("rank", _text("paper_title").alias("title"), "abstract")).alias("_first"))
    place = Window.partitionBy("query_id").orderBy("_first.rank")
    return first.select(
        "query_id", F.row_number().over(place).alias("position"), "paper_id", "_first.title",
        snippet(F.col("_first.abstract")).alias("abstract_snippet"))


def media_markdown(sections: DataFrame, max_items: int = MEDIA_ITEMS) -> DataFrame:
    """``query_id, n_items, markdown`` of the retrieved tables and linked figures."""
    body = strip_ws(_text("text"))
    title = F.when(_text("paper_title") != "", F.col("paper_title")).otherwise(_text("paper_id"))
    is_table, is_figure = F.col("content_type") == "table", F.col("content_type") == "figure"
    shown = sections.filter((is_table & (body != "")) | (is_figure & (_text("media_url") != "")))
    rendered = shown.select(
        "query_id", "rank",
        F.when(is_table, F.concat_ws(":", F.lit("t"), _text("paper_id"), body))
        .otherwise(F.concat(F.lit("f:"), F.col("media_url"))).alias("_key"),
        F.when(is_table, F.concat(
            F.when(title != "", F.concat(F.lit("**Table — "), title, F.lit("**")))
            .otherwise("**Table**"), F.lit("\n\n"), body))
        .otherwise(F.concat(F.lit("!["), F.when(body != "", body).otherwise("Figure"), F.lit("]("),
                            F.col("media_url"), F.lit(")"))).alias("_item"))
    distinct = rendered.groupBy("query_id", "_key").agg(
        F.min(F.struct("rank", "_item")).alias("_first"))
    kept = top_k(distinct, ["query_id"], [F.asc("_first.rank"), F.asc("_key")], max_items, "_row")
    return kept.groupBy("query_id").agg(
        F.count("*").cast("int").alias("n_items"),
        F.concat(F.lit("\n\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_row", "_first._item"))),
            lambda s: s["_item"]), "\n\n")).alias("markdown"))
