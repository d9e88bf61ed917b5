"""Evaluation sets as a model returns them: JSON arrays, sometimes wrapped in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrag import schemas


def _lenient(raw: Column, schema: str) -> Column:
    """Parse the text, else the span from its first ``[`` to its last ``]``, else NULL."""
    whole = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    span = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), schema, {"mode": "PERMISSIVE"})
    return F.when(raw.rlike(r"(?s)^\s*\["), F.coalesce(whole, span)).otherwise(span)


def parse_flags(df: DataFrame, raw_col: str, schema: str = schemas.QRELS_JSON) -> DataFrame:
    """The rows with ``parsed`` (false where no array could be read)."""
    return df.withColumn("parsed", _lenient(F.col(raw_col), schema).isNotNull())


def load_qrels_json(df: DataFrame, raw_col: str, strict: bool = False) -> DataFrame:
    """``query_id, chunk_id, relevance`` (always 1). Unreadable text yields no rows, or an
    error with ``strict``; see ``parse_flags`` for a report."""
    parsed = _lenient(F.col(raw_col), schemas.QRELS_JSON)
    if strict:
        parsed = F.when(parsed.isNull(), F.raise_error(F.concat(
            F.lit("not a JSON array: "), F.col(raw_col)))).otherwise(parsed)
    entries = df.select(F.explode(parsed).alias("e"))
    return entries.select(F.col("e.query").alias("query_id"),
                          F.explode("e.relevant_chunk_ids").alias("chunk_id")).distinct().withColumn(
        "relevance", F.lit(1))


def load_eval_dataset_json(df: DataFrame, raw_col: str) -> DataFrame:
    """``question, answer, contexts`` and ``complete``: all three fields are required."""
    entries = df.select(F.explode(_lenient(F.col(raw_col), schemas.QA_JSON)).alias("e"))
    return entries.select(
        "e.question", "e.answer", "e.contexts",
        (F.col("e.question").isNotNull() & F.col("e.answer").isNotNull()
         & F.col("e.contexts").isNotNull()).alias("complete"))
