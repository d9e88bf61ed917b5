"""Atom feeds to paper rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrag.functions.rules import canonical_paper_id
from corrag.functions.text import strip_ws

_FEED = ("struct<entry:array<struct<id:string,title:string,summary:string,published:string,"
         "author:array<struct<name:string>>>>>")


def parse_atom_entries(feeds: DataFrame, xml_col: str) -> DataFrame:
    """``paper_id, title, abstract, authors, published_date`` per entry with an id.

    A feed that is not well formed yields no rows.
    """
    parsed = F.from_xml(F.col(xml_col), _FEED, {"rowTag": "feed", "mode": "PERMISSIVE"})
    entries = feeds.select(F.explode(parsed["entry"]).alias("e")).filter(
        strip_ws(F.coalesce(F.col("e.id"), F.lit(""))) != "")

    def text(name: str):
        return strip_ws(F.coalesce(F.col(f"e.{name}"), F.lit("")))

    return entries.select(
        canonical_paper_id(F.col("e.id")).alias("paper_id"), text("title").alias("title"),
        text("summary").alias("abstract"),
        F.coalesce(F.transform("e.author", lambda a: F.coalesce(a["name"], F.lit(""))),
                   F.array().cast("array<string>")).alias("authors"),
        text("published").alias("published_date"))
