"""Grouping helpers that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Rank rows per key and keep ``rank <= k``.

    Spark turns the filter into a group limit that runs before the shuffle, so a task sends
    at most ``k`` rows per key however many it holds.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def joined_in_order(
    df: DataFrame, keys: list[str], position: str, text: str, separator: str,
    block: int = 1024, out: str | None = None,
) -> DataFrame:
    """Concatenate ``text`` by ``position`` per key, in two levels.

    Runs of ``block`` positions are joined first, spread over all tasks, so the last step
    handles one already joined piece per run and no task sorts a whole large group.
    """
    out = out or text
    run = F.floor(F.col(position) / block)
    pieces = (
        df.groupBy(*keys, run.alias("_run"))
        .agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(position, text))), lambda s: s[text]),
            separator).alias("_piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_run", "_piece"))), lambda s: s["_piece"]),
        separator).alias(out))
