"""The chunk store: idempotent replacement per paper, and JSON reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag import schemas

STORE_BUCKETS = 1024


def papers_to_replace(incoming_papers: DataFrame, existing_papers: DataFrame | None,
                      force: bool = False) -> DataFrame:
    """Papers whose chunks the incoming run replaces: all but those already ``full``."""
    ids = incoming_papers.select("paper_id").distinct()
    if force or existing_papers is None:
        return ids
    done = existing_papers.filter(F.col("ingestion_status") == "full").select("paper_id")
    return ids.join(done, "paper_id", "left_anti")


def upsert_paper_chunks(
    existing: DataFrame, incoming: DataFrame, incoming_papers: DataFrame,
    existing_papers: DataFrame | None = None, force: bool = False,
) -> DataFrame:
    """The store after the run: old rows of replaced papers go, their new rows come.

    ``incoming_papers`` lists every paper of the run, so a paper whose new run produced
    nothing still loses its old rows. Works for chunks, vectors and postings alike.
    """
    replaced = papers_to_replace(incoming_papers, existing_papers, force)
    kept = existing.join(replaced, "paper_id", "left_anti")
    new = incoming.join(replaced, "paper_id", "left_semi")
    return kept.unionByName(new)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, buckets: int = STORE_BUCKETS) -> None:
    """First write of a store, in one folder per paper bucket.

    Rebalancing groups the rows by bucket but splits a bucket that one large paper fills.
    """
    rows.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.partitionBy(
        "bucket").mode("errorifexists").parquet(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType, papers: list[str] | None = None,
               buckets: int = STORE_BUCKETS) -> DataFrame:
    """The table's rows; with ``papers`` only theirs, read from no bucket but their own."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(full).parquet(path).filter(F.col("paper_id").isNotNull())
    if papers is not None:
        own = [F.pmod(F.xxhash64(F.lit(p)), F.lit(buckets)).cast("int") for p in papers]
        rows = rows.filter(F.col("bucket").isin(own) & F.col("paper_id").isin(papers))
    return rows.drop("bucket")


def upsert_store(
    spark: SparkSession, path: str, incoming: DataFrame, incoming_papers: DataFrame,
    schema: T.StructType, buckets: int = STORE_BUCKETS, existing_papers: DataFrame | None = None,
    force: bool = False,
) -> None:
    """Apply ``upsert_paper_chunks`` in place.

    Only the folders of buckets that hold a replaced paper are read and written; the rest of
    the store is not touched. Staged files replace a folder when the job commits, so a lost
    executor or a failed job leaves the old rows.
    """
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    replaced = papers_to_replace(incoming_papers, existing_papers, force)
    # At most ``buckets`` small numbers.
    touched = [row.bucket for row in replaced.select(_bucket(buckets).alias("bucket")).distinct().collect()]
    if not touched:
        return
    names = [f.name for f in schema.fields]
    try:
        existing = spark.read.schema(full).parquet(path).filter(
            F.col("bucket").isin(touched) & F.col("paper_id").isNotNull())
    except AnalysisException:
        existing = spark.createDataFrame([], full)
    new = incoming.join(replaced, "paper_id", "left_semi").select(*names).withColumn("bucket", _bucket(buckets))
    after = existing.join(replaced, "paper_id", "left_anti").select(*names, "bucket").unionByName(new)
    # A bucket left without rows still has to lose its old files, so each gets a marker row
    # without a paper, which readers skip.
    markers = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), "bucket")
    after = after.unionByName(markers)
    (after.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").partitionBy("bucket").parquet(path))


def write_report(scores: DataFrame, path: str, name: str, replace: bool = True) -> None:
    """One JSON folder per report name and paper. The papers in ``scores`` are replaced, or added to
    without ``replace``; those of other papers stay."""
    (scores.write.option("partitionOverwriteMode", "dynamic").mode("overwrite" if replace else "append")
     .partitionBy("paper_id").json(f"{path}/{name}"))


def read_report(spark: SparkSession, path: str, name: str, schema: T.StructType = schemas.SCORES) -> DataFrame:
    try:
        return spark.read.schema(schema).json(f"{path}/{name}")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no report {name!r} under {path}") from missing
