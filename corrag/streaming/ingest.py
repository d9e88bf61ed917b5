"""Pages that keep arriving, ingested into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrag.plans.corpus import Settings
from corrag.plans.ingest import ingest_to_store
from corrag.sources.store import STORE_BUCKETS


def stream_ingest(
    pages: DataFrame, store: str, checkpoint: str, settings: Settings = Settings(),
    root: str = "section", buckets: int = STORE_BUCKETS, available_now: bool = False,
    order_by: str | None = None,
) -> StreamingQuery:
    """Each micro-batch replaces its papers in the store.

    Replacement is by paper, so a page that arrives twice, or a batch that runs again after a
    failure, leaves one set of chunks. Within a batch the page with the highest ``order_by``
    wins (without it, the greatest text, so that a repeated batch gives the same result).
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("paper_id").agg(
            F.max_by("html", order_by or "html").alias("html")).persist()
        papers = newest.select("paper_id", F.lit("").alias("title"), F.lit("").alias("abstract"))
        try:
            ingest_to_store(batch.sparkSession, store, papers, newest, settings=settings, root=root,
                            buckets=buckets)
        finally:
            newest.unpersist()

    writer = pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
