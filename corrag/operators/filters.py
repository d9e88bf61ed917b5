"""Row filters and flags: noisy blocks, evidence grades, request checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.functions.rules import (
    EQUATION_MIN_PROSE, GRADE_HIGH, GRADE_LOW, grade_reason, is_equation_only, says_yes)
from corrag.functions.text import strip_ws

# --- Fixed values -------------------------------------------------------------------------
DROP_PREFIXES = (
    "references",
    "bibliography",
    "acknowledgements",
    "acknowledgments",
    "funding",
    "appendix",
    "author contributions",
    "conflict of interest",
    "conflicts of interest",
    "data availability",
    "supplementary",
)
KEEP_PREFIXES = ("abstract",)
MESSAGE_CHARS, TITLE_CHARS = 8000, 120
# -----------------------------------------------------------------------------------------


def filter_blocks(
    blocks: DataFrame, drop: tuple[str, ...] = DROP_PREFIXES, keep: tuple[str, ...] = KEEP_PREFIXES,
    min_prose: int = EQUATION_MIN_PROSE,
) -> DataFrame:
    """Drop low-signal sections by name and prose that is only formulas."""
    name = strip_ws(F.lower("section_name"))

    def begins_with(prefixes):
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | F.startswith(name, F.lit(prefix.lower()))
        return hit

    formulas = (F.col("content_type") == "text") & is_equation_only(F.col("text"), min_prose)
    return blocks.filter(begins_with(keep) | (~begins_with(drop) & ~formulas))


def grade(
    queries: DataFrame, hits: DataFrame, verdicts: DataFrame | None = None,
    high: float = GRADE_HIGH, low: float = GRADE_LOW,
) -> DataFrame:
    """``query_id, top_score, sufficient, reason, needs_judge`` for every query.

    Scores must be rerank scores (0 to 1). ``verdicts`` holds a judge's raw ``verdict`` per
    ``query_id`` and only matters between the thresholds.
    """
    top = hits.groupBy("query_id").agg(F.max("score").alias("_top"))
    graded = queries.select("query_id", "mode").join(top, "query_id", "left").withColumn(
        "top_score", F.coalesce("_top", F.lit(0.0)))
    graded = (graded.withColumn("verdict", F.lit(None).cast("string")) if verdicts is None
              else graded.join(verdicts.select("query_id", "verdict"), "query_id", "left"))
    decided = grade_reason(F.col("top_score"), F.col("mode"), high, low)
    return graded.select(
        "query_id", "top_score",
        F.when(decided.isNotNull(), F.col("top_score") >= high)
        .otherwise(F.coalesce(says_yes(F.col("verdict")), F.lit(False))).alias("sufficient"),
        F.coalesce(decided, F.lower(strip_ws(F.col("verdict")))).alias("reason"),
        (decided.isNull() & F.col("verdict").isNull()).alias("needs_judge"))


def check_requests(requests: DataFrame) -> DataFrame:
    """Flag rows that break the request rules; columns that are absent are not checked."""
    checks = []
    if "mode" in requests.columns:
        mode = F.coalesce(F.col("mode"), F.lit(""))
        checks.append((~mode.isin("ask", "deep_dive"), "unknown mode"))
        checks.append(((mode == "deep_dive") & (F.coalesce(F.col("paper_id"), F.lit("")) == ""),
                       "deep_dive without paper_id"))
    if "content" in requests.columns:
        size = F.length(F.coalesce(F.col("content"), F.lit("")))
        checks.append(((size < 1) | (size > MESSAGE_CHARS), "message length"))
    if "title" in requests.columns:
        title = F.coalesce(F.col("title"), F.lit(""))
        checks.append((strip_ws(title) == "", "blank title"))
        checks.append((F.length(title) > TITLE_CHARS, "title length"))
    flags = F.array(*(F.when(broken, F.lit(name)) for broken, name in checks))
    return requests.withColumn("violations", F.filter(flags, lambda v: v.isNotNull()))
