"""Stored postings in order of impact, with block maxima: sparse search that skips what cannot win.

A row of the index is a block of one term: its best weight, and chunks with their weights. The first block of
a term holds its heaviest entries, the next ones lighter and lighter ones. A term with very many entries is
cut into ranges of chunks first, each ordered for itself, so no task sorts one frequent term.

A search knows a floor per query that a result has to reach. The terms of a query that cannot reach it even
together are not essential: a chunk needs another term as well. Only blocks of essential terms are opened,
and of these only blocks whose best weight reaches the floor together with the best of all other terms. Chunks
found there that may still reach it are completed from their own vectors. Frequent terms, which weigh
little, are thus hardly ever opened, and every score that counts is exact: weights are positive.

``impact_search`` takes the floor from the chunks that are best in the first blocks; ``ranks_of`` from the
scores of judged chunks, so that no full ranking is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corrag.operators.batches import list_lengths
from corrag.operators.blockmatch import SCORE_DIGITS
from corrag.operators.postings import postings
from corrag.operators.termmatch import TERM_BLOCK, scored_parts, term_block
from corrag.operators.topk import top_k
from corrag.session import staged

#: Entries of a term's first block, and of its largest ones; blocks double in between.
FIRST_BLOCK, LARGEST_BLOCK = 64, 4096
#: Entries of a term in one range of chunks, about.
RANGE_ENTRIES = 1 << 20
#: Folders of the stored index; a term lives in one of them.
TERM_BUCKETS = 256
#: What rounding may add to a score.
_MARGIN = 10.0 ** -SCORE_DIGITS


def schema(chunk_type: T.DataType = T.StringType(), paper_type: T.DataType = T.StringType()) -> T.StructType:
    entry = T.StructType([T.StructField("chunk_id", chunk_type), T.StructField("paper_id", paper_type),
                          T.StructField("weight", T.DoubleType())])
    return T.StructType([
        T.StructField("term", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("max_weight", T.DoubleType()), T.StructField("n", T.LongType()),
        T.StructField("entries", T.ArrayType(entry)), T.StructField("bucket", T.IntegerType())])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _block(place: Column) -> Column:
    """The block of the entry at this place (from 1) of its term and range."""
    ends = [FIRST_BLOCK]
    while ends[-1] < 2 * LARGEST_BLOCK:
        ends.append(2 * ends[-1])
    doubling = sum((place > end).cast("int") for end in ends[:-1])
    return doubling + F.greatest(F.lit(0), F.floor((place - 1 - ends[-1]) / LARGEST_BLOCK) + 1).cast("int")


def impact_blocks(vectors: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Sparse vectors (``chunk_id, paper_id, terms, weights``) as blocks: ``term, range, block, max_weight, n,
    entries``. Entries without a positive weight score nothing and are left out."""
    entries = postings(vectors).filter(F.col("weight") > 0)
    heavy = entries.groupBy("term").agg(F.count("*").alias("_n")).filter(F.col("_n") > range_entries)
    ranges = F.coalesce(F.ceil(F.col("_n") / range_entries), F.lit(1))
    placed = entries.join(heavy, "term", "left").withColumn(
        "range", F.pmod(F.xxhash64("chunk_id"), ranges).cast("int"))
    ordered = top_k(placed, ["term", "range"], [F.desc("weight"), F.asc("chunk_id")], None, "_place")
    return (ordered.withColumn("block", _block(F.col("_place")))
            .groupBy("term", "range", "block").agg(
                F.max("weight").alias("max_weight"), F.count("*").alias("n"),
                F.collect_list(F.struct("chunk_id", "paper_id", "weight")).alias("entries")))


def write_impacts(vectors: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Write the index, one folder per bucket of terms, its rows sorted by term."""
    blocks = impact_blocks(vectors).withColumn("bucket", _bucket(buckets))
    (blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range", "block")
     .write.partitionBy("bucket").mode("errorifexists").parquet(path))


def open_impacts(spark: SparkSession, path: str, query_terms: DataFrame | None = None, buckets: int = TERM_BUCKETS,
                 chunk_type: T.DataType = T.StringType(), paper_type: T.DataType = T.StringType()) -> DataFrame:
    """The stored index; with ``query_terms`` only the folders that hold one of their terms are read."""
    rows = spark.read.schema(schema(chunk_type, paper_type)).parquet(path)
    if query_terms is None:
        return rows
    # At most ``buckets`` small numbers.
    own = [row.bucket for row in query_terms.select(_bucket(buckets).alias("bucket")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(own))


def _asked(query_terms: DataFrame) -> DataFrame:
    """``query_id, term, _qw, scope``: staged, since several steps read it."""
    scope = F.col("scope").cast("string") if "scope" in query_terms.columns else F.lit(None).cast("string")
    return staged(query_terms.filter(F.col("weight") > 0).select(
        "query_id", "term", F.col("weight").alias("_qw"), scope.alias("scope")), "query-terms")


def _in_scope() -> Column:
    return F.col("scope").isNull() | (F.col("scope") == F.col("paper_id").cast("string"))


def _entries(opened: DataFrame, *columns: str) -> DataFrame:
    """The entries of blocks that met their queries, as ``query_id, chunk_id, paper_id, gain``."""
    flat = opened.select("query_id", "scope", "_qw", *columns, F.explode("entries").alias("_e")).select(
        "query_id", "scope", "_qw", *columns, "_e.chunk_id", "_e.paper_id", "_e.weight")
    return flat.filter(_in_scope()).select("query_id", "chunk_id", "paper_id", *columns, (F.col("_qw") * F.col("weight")).alias("gain"))


def complete_scores(asked: DataFrame, vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``query_id, chunk_id, paper_id, score`` of pairs that share a term, from the vectors of their chunks alone.

    A chunk is read once with the list of its queries. The terms of the queries travel to the workers in blocks, as
    in ``sparse_search``: nothing is multiplied out by terms and queries of a chunk.
    """
    wanted = pairs.select("query_id", "chunk_id").distinct()
    n = max(1, -(-asked.count() // TERM_BLOCK))
    mine = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionByName, (
        _complete_block(asked.filter(mine == i), vectors, wanted.filter(mine == i)) for i in range(n)))


def _complete_block(asked: DataFrame, vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    terms = asked.select("query_id", "term", F.col("_qw").alias("weight"), "scope")
    shipped = asked.sparkSession.sparkContext.broadcast(term_block(terms.toArrow()))
    result = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        *(T.StructField(c, vectors.schema[c].dataType) for c in ("chunk_id", "paper_id")), T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        query_ids = pa.array(block.query_ids, arrow_schema.field("query_id").type)
        for records in batches if block.query_ids else ():
            for part, ids, scores in scored_parts(block, records):
                queries = pc.index_in(part.column("_queries").flatten(), query_ids).fill_null(-1).to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(part)), list_lengths(part.column("_queries")))
                found = np.where(queries >= 0, scores[queries, rows], -np.inf)
                hit = np.flatnonzero(found > 0)
                at = pa.array(rows[hit])
                yield pa.RecordBatch.from_arrays([
                    query_ids.take(pa.array(queries[hit])), part.column("chunk_id").take(at), part.column("paper_id").take(at),
                    pa.array(found[hit])], schema=arrow_schema)

    lists = wanted.groupBy("chunk_id").agg(F.collect_list("query_id").alias("_queries"))  # at most every query
    return vectors.select("chunk_id", "paper_id", "terms", "weights").join(lists, "chunk_id").select(
        "chunk_id", "paper_id", "terms", "weights", "_queries").mapInArrow(run, result)


def _cells(asked: DataFrame, index: DataFrame, floors: DataFrame) -> DataFrame:
    """The blocks of each query's terms, ``open`` or not, with their number of entries ``n``; ``_rest`` is what
    its other, not essential terms can add. ``floors`` is ``query_id, floor``; a query without one opens all.
    Only the small columns of the index are read here."""
    heads = index.filter(F.col("block") == 0).groupBy("term").agg(F.max("max_weight").alias("_top"))
    query = Window.partitionBy("query_id")
    least = F.col("floor") - 2 * _MARGIN
    reach = asked.join(heads, "term").join(floors, "query_id", "left").withColumn("_most", F.col("_qw") * F.col("_top"))
    known = reach.withColumns({
        "_total": F.sum("_most").over(query),
        "_upto": F.sum("_most").over(query.orderBy("_most", "term").rowsBetween(Window.unboundedPreceding, 0))})
    essential = F.col("floor").isNull() | (F.col("_upto") >= least)
    judged = known.withColumn("_essential", essential).withColumn(
        "_rest", F.sum(F.when(F.col("_essential"), 0.0).otherwise(F.col("_most"))).over(query))
    bound = F.col("_total") - F.col("_most") + F.col("_qw") * F.col("max_weight")
    blocks = index.select("term", "range", "block", "max_weight", "n")
    return judged.join(blocks, "term").select(
        "query_id", "term", "scope", "_qw", "floor", "_rest", "range", "block", "n",
        (F.col("_essential") & (F.col("floor").isNull() | (bound >= least))).alias("open"))


def scores_above(asked: DataFrame, index: DataFrame, vectors: DataFrame, floors: DataFrame) -> DataFrame:
    """``query_id, chunk_id, paper_id, score`` of all chunks that reach their query's floor; of others some may
    come along, with scores below it."""
    opened = _cells(asked, index, floors).filter("open").join(
        index.select("term", "range", "block", "entries"), ["term", "range", "block"])
    found = _entries(opened, "floor", "_rest").groupBy("query_id", "chunk_id", "paper_id").agg(
        F.sum("gain").alias("_gain"), F.first("floor").alias("floor"), F.first("_rest").alias("_rest"))
    hopeful = staged(found.filter(F.col("floor").isNull() | (F.col("_gain") + F.col("_rest") >= F.col("floor") - 2 * _MARGIN)), "hopeful")
    columns = "query_id", "chunk_id", "paper_id", "score"
    whole = hopeful.filter(F.col("floor").isNull()).withColumn("score", F.round("_gain", SCORE_DIGITS))
    return whole.select(*columns).unionByName(
        complete_scores(asked, vectors, hopeful.filter(F.col("floor").isNotNull())).select(*columns))


def _best_first() -> list[Column]:
    return [F.desc("score"), F.asc("chunk_id")]


def _head_floors(asked: DataFrame, index: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """``query_id, floor``: the worst score of the ``limit`` chunks that are best in the first blocks."""
    heads = _entries(asked.join(index.filter(F.col("block") == 0).select("term", "entries"), "term"))
    partial = heads.groupBy("query_id", "chunk_id").agg(F.round(F.sum("gain"), SCORE_DIGITS).alias("score"))
    best = staged(top_k(partial, ["query_id"], _best_first(), limit), "heads")
    return complete_scores(asked, vectors, best).groupBy("query_id").agg(
        F.min("score").alias("floor"), F.count("*").alias("_n")).filter(F.col("_n") == limit).drop("_n")


def impact_search(query_terms: DataFrame, index: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Exact top ``limit`` per query, as ``sparse_search`` gives from the vectors alone.

    ``query_terms`` is ``query_id, term, weight`` and may carry ``scope``, the only paper to look at."""
    asked = _asked(query_terms)
    floors = staged(_head_floors(asked, index, vectors, limit), "floors")
    found = scores_above(asked, index, vectors, floors).filter(F.col("score") > 0)
    return top_k(found, ["query_id"], _best_first(), limit)


def impact_report(query_terms: DataFrame, index: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Per query how much of its postings a search opens: ``query_id, postings, opened, blocks, opened_blocks``."""
    asked = _asked(query_terms)
    floors = staged(_head_floors(asked, index, vectors, limit), "floors")
    return _cells(asked, index, floors).groupBy("query_id").agg(
        F.sum("n").alias("postings"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("opened"),
        F.count("*").alias("blocks"), F.count_if("open").alias("opened_blocks"))


def ranks_of(query_terms: DataFrame, index: DataFrame, vectors: DataFrame, judged: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of judged pairs in the full ranking of their query.

    The rank counts the chunks with a better score, or the same score and a smaller id. Only chunks that
    reach the worst judged score of a query are scored, and only counts leave the sum."""
    asked = _asked(query_terms)
    known = staged(complete_scores(asked, vectors, judged), "judged-scores")
    floors = known.groupBy("query_id").agg(F.min("score").alias("floor"))
    mine = asked.join(floors.select("query_id"), "query_id", "left_semi")
    scored = scores_above(mine, index, vectors, floors).join(floors, "query_id").filter(F.col("score") >= F.col("floor"))
    # Each scored chunk goes to the worst judged pair that it is not behind; better pairs add up what lies above them.
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "chunk_id")))
    lists = known.groupBy("query_id").agg(pairs.alias("_pairs"))  # as many as a query has judgements
    at = F.size(F.filter("_pairs", lambda p: (p["minus"] < -F.col("score")) | (
        (p["minus"] == -F.col("score")) & (p["chunk_id"] < F.col("chunk_id")))))
    steps = scored.join(lists, "query_id").groupBy("query_id", at.alias("_step")).agg(F.count("*").alias("_n"))
    counted = steps.groupBy("query_id").agg(F.collect_list(F.struct("_step", "_n")).alias("_steps"))
    ranked = lists.select("query_id", F.posexplode("_pairs").alias("_at", "_pair")).join(counted, "query_id")
    above = F.aggregate(F.filter("_steps", lambda s: s["_step"] <= F.col("_at")), F.lit(0).cast("long"), lambda n, s: n + s["_n"])
    return ranked.select("query_id", "_pair.chunk_id", (-F.col("_pair.minus")).alias("score"), above.cast("int").alias("rank"))
