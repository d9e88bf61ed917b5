"""Pieces that several operators share: paths, table reads and batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrag.session import staged

#: What lies between two words, as a Java and Python pattern.
GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Column: the words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def slices(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to ``most`` or less; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, row after the last, texts) of slices of about ``most`` bytes: a task holds a slice as
    Python values, not the batch."""
    for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), most):
        yield a, b, texts.slice(a, b - a).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a number for each row that stays the same however often the result is read.

    Rows of Parquet files are named by file and place. Any other table is written once with its numbers.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        source = plan.relation()
        if source.getClass().getSimpleName() == "HadoopFsRelation" and source.fileFormat().toString() == "Parquet":
            place = docs.metadataColumn("_metadata")
            files = docs.select(place["file_path"].alias("_in_file")).distinct()
            files = staged(files.withColumn("_file_number", F.row_number().over(Window.orderBy("_in_file"))), "files")  # one row a file
            rows = docs.withColumns({"_in_file": place["file_path"], column: place["row_index"]})
            named = rows.join(files, "_in_file")
            return named.withColumn(column, F.shiftleft(F.col("_file_number").cast("long"), 40) + F.col(column)).select(*docs.columns, column)
    return staged(docs.withColumn(column, F.monotonically_increasing_id()), "rows")


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            if folder.rpartition("/")[0].endswith("/corrag"):  # where staged() writes
                delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
