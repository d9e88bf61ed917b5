"""Sharding by a minimax contiguous partition, in DataFrame and SQL functions only.

Equal texts form one atomic group. Groups stand in the order of their smallest id; the smallest
shard capacity for which ``n_shards`` contiguous runs suffice is found by search over capacities,
each checked greedily, and the order is cut there. A round checks up to ``PROBES`` capacities at
once: each greedy step is one lookup of the furthest prefix sum within reach, done as a join of
the few probes with the groups on a block of the prefix sums. No row is sent to the driver but one
prefix sum per probe.

Law: ``bytes``. The largest shard is as small as any contiguous cut between whole groups allows.

Defined results: a null text has size 1 and forms one group with the other null texts, apart from
empty ones. A group larger than the mean shard has a shard to itself and its neighbours as far as
they fit. With fewer groups than shards the last shards are empty. An empty table gives no rows.
Repeated rows belong to the same group; rows with equal ids are numbered in any fixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from corrag.llm.common import read_table
from corrag.session import staged

#: Capacities that one round of the search checks.
PROBES = 63
#: Blocks that the prefix sums are cut into; the driver holds one number per block.
BLOCKS = 1 << 14


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` in global order with ``_part`` and ``_at``, the place in the partition; staged, so it is fixed."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return staged(sorted_rows.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "numbered")


def prefix_sums(groups: DataFrame, order: str, size: str) -> DataFrame:
    """``groups`` with ``cum``, the sum of ``size`` up to and with the row, in the order of a unique column."""
    rows = _numbered(groups, order)
    totals = rows.groupBy("_part").agg(F.sum(size).alias("_sum"))  # one row per partition
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(size).over(Window.partitionBy("_part").orderBy("_at"))
    return (rows.withColumn("_within", within).join(before, "_part")
            .withColumn("cum", F.col("_before") + F.col("_within")).drop("_part", "_at", "_within", "_before"))


def _furthest(spark, blocks: DataFrame, width: int, before: list[int], targets: dict[int, int]) -> dict[int, int]:
    """For each probe the largest prefix sum that is not above its target, or 0: one in the target's
    block, or else the last one before that block."""
    values = ", ".join(f"({k}L, {t}L, {t // width}L)" for k, t in targets.items())
    probes = spark.sql(f"SELECT * FROM VALUES {values} AS p(probe, target, block)")
    found = (
        blocks.join(F.broadcast(probes), "block")  # at most PROBES + 1 rows
        .filter(F.col("cum") <= F.col("target"))
        .groupBy("probe").agg(F.max("cum").alias("cum")).collect())
    return {k: before[t // width] for k, t in targets.items()} | {r["probe"]: r["cum"] for r in found}


def minimax_cuts(cums: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the prefix sums at which the greedy cut ends each shard."""
    spark = cums.sparkSession
    total, largest = cums.agg(F.max("cum"), F.max("bytes")).first()
    if total is None:
        return 0, []
    width = total // BLOCKS + 1
    blocks = staged(cums.select(F.expr(f"cum div {width}L").alias("block"), "cum").repartitionByRange("block"), "prefix-sums")
    ends = dict(blocks.groupBy("block").agg(F.max("cum")).collect())  # at most BLOCKS numbers
    before, last = [], 0
    for block in range(BLOCKS + 1):
        before.append(last)
        last = ends.get(block, last)

    def greedy(capacities):
        cuts = {k: [0] for k in range(len(capacities))}
        for _ in range(n_shards):
            open_ = {k: min(c[-1] + capacities[k], total) for k, c in cuts.items() if c[-1] < total}
            if open_:
                for k, cum in _furthest(spark, blocks, width, before, open_).items():
                    cuts[k].append(cum)
        return [cuts[k][1:] for k in range(len(capacities))]

    # Every group fits into the upper bound's rest, so the upper bound is feasible.
    mean = -(-total // n_shards)
    low, high = max(mean, largest), mean + largest
    cuts = greedy([high])[0]
    while low < high:
        step = max(1, (high - low) // (PROBES + 1))
        tried = list(range(low, high, step))[:PROBES + 1]
        for capacity, ends in zip(tried, greedy(tried)):
            if ends[-1] >= total:
                high, cuts = capacity, ends
                break
            low = capacity + 1
    return high, cuts


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, capacity."""
    text = F.col(text_col)
    sized = staged(docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.encode(F.lit("null"), "UTF-8")).alias("_text")), "sizes")
    groups = sized.groupBy("_text").agg(F.sum("size").alias("bytes"), F.min("_id").alias("_first"))
    cums = staged(prefix_sums(groups, "_first", "bytes"), "groups")
    capacity, cuts = minimax_cuts(cums, n_shards)
    shard = sum(((F.col("cum") > F.lit(c)).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = sized.join(cums.select("_text", shard.alias("shard")), "_text").drop("_text")
    rows = _numbered(placed, "shard", "_id")
    runs = rows.groupBy("_part", "shard").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    return rows.join(runs.withColumn("_earlier", earlier), ["_part", "shard"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_at") - F.col("_start") + F.col("_earlier")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))


def query_sharding(spark, sf_dir):
    return shard_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
