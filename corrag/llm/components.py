"""Connected components of a link table, by alternating large and small stars.

Every round writes its links to the shared folder, so lineage stays short and a lost executor costs a
re-read. Links are combined before they are shuffled; nothing is collected but one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrag.session import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionAll(least.select("a", F.col("least").alias("b"))).filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for all linked nodes but the smallest of each component.

    ``links`` has two columns of ids; loops and repeated links do no harm. A node that is missing from
    the result is the smallest of its component.
    """
    a, b = links.columns
    now = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                 .filter(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    while True:
        now = staged(_small_star(_large_star(now)), "links")
        # Both steps leave links alone that are stars with the smallest node in the centre, and only those.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = state


def with_component(nodes: DataFrame, id_col: str, links: DataFrame) -> DataFrame:
    """``nodes`` with ``component_id``; a node without links is its own component."""
    found = components(links)
    return (nodes.join(found.withColumnRenamed("node", id_col), id_col, "left")
            .withColumn("component_id", F.coalesce("component", id_col)).drop("component"))
