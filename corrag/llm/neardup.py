"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

1. Equal vectors form one class. Every class gets, in each of some tables, a bucket from ``k``
   cross-polytopes: the vector is rotated by three rounds of random signs and a fast Hadamard
   transform, and the largest coordinate with its sign is the hash. ``k`` grows with the logarithm of
   the number of classes, so that buckets keep their size. Multiprobe adds, per polytope, the bucket
   with the second-largest coordinate in its place. There are ``TABLES`` tables, and more where ``k`` and the
   dimension ask for it, so that at most ``MISS`` of the pairs at cosine ``least`` are expected to meet nowhere.
2. Classes are compared in the buckets where they meet and one of them is at home. Buckets with one
   class send no vector. A large bucket is cut into chunks and the pairs of chunks go to different
   tasks. A pair counts in the first bucket in which it meets only.
3. Candidate pairs are verified by cosine in double precision. Tasks return link counts and the
   edges of a spanning forest, never pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing. Vectors of different lengths never link. Equal vectors link with each other whatever their
norm. An empty table gives no rows. Labels and extra columns are not read. Classes have numbers of their own, so ids
may repeat or be null: every row comes out once and counts as a vector, and ``component_id`` is the smallest id that is not
null. All rows with that id are kept; where a component has null ids only, ``component_id`` is null and all are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import mix, read_table
from corrag.llm.components import components
from corrag.session import staged

#: Least number of tables.
TABLES = 4
#: Share of pairs at the threshold that may meet in no table.
MISS = 0.002
#: Classes that a bucket holds at home, about.
BUCKET_ROWS = 512
#: Classes of a chunk of a large bucket, about.
CHUNK = 2048
_SEED = 20_240_601


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def bucket_keys(vectors: np.ndarray, k: int, tables: int = TABLES) -> np.ndarray:
    """Rows x (tables x (1 + k)) bucket ids; of each table first the home, then the probes."""
    n, d = vectors.shape
    size = 1 << max(0, int(d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    rng = np.random.default_rng([_SEED, d])
    keys = []
    for table in range(tables):
        best, second = [], []
        for _ in range(k):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice((-1.0, 1.0), size))
            order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :2] if size > 1 else np.zeros((n, 2), np.int64)
            signs = np.take_along_axis(x, order, axis=1) < 0
            found = (order * 2 + signs).astype(np.uint64)
            best.append(found[:, 0])
            second.append(found[:, 1])
        for probe in range(k + 1):
            h = np.full(n, table * 1000003 + d, np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + (second[j] if j == probe - 1 else best[j]))
            keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def tables_needed(k: int, dimensions: int, least: float) -> int:
    """Tables after which pairs at cosine ``least`` are missed at a rate of ``MISS`` or less.

    A pair meets in a table if all polytopes agree, or all but one whose probe agrees; how often one does is
    drawn with fixed seeds, less two standard errors.
    """
    size = 1 << max(0, int(dimensions - 1).bit_length())
    if size == 1 or not -1 < least < 1:
        return TABLES
    rng, left, agree, probed, drawn = np.random.default_rng(_SEED), 8192 if size <= 4096 else 512, 0, 0, 0
    while left > 0:
        n = min(left, max(1, (1 << 21) // size))
        x, noise = rng.normal(size=(2, n, size))
        y = least * x + np.sqrt(1 - least * least) * noise
        (a, a2), (b, b2) = (np.split(2 * at + (np.take_along_axis(m, at, axis=1) < 0), 2, axis=1) for m, at in (
            (m, np.argpartition(-np.abs(m), [0, 1] if size > 2 else 0, axis=1)[:, :2]) for m in (x, y)))
        agree += int((a == b).sum())
        probed += int(((a != b) & ((a == b2) | (a2 == b))).sum())
        drawn, left = drawn + n, left - n
    p, q = agree / drawn, probed / drawn
    p = max(0.01, p - 2 * np.sqrt(p * (1 - p) / drawn))
    meets = p ** k + k * p ** (k - 1) * q
    return TABLES if meets >= 1 else max(TABLES, int(np.ceil(np.log(MISS) / np.log1p(-meets))))


def _matrices(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_length.setdefault(len(r), []).append(i)
    return {d: (np.array(at), np.array([rows[i] for i in at], np.float64)) for d, at in by_length.items()}


def _signed(k: int, tables: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            keys = np.empty((len(vectors), tables * (k + 1)), np.int64)
            for at, matrix in _matrices(vectors).values():
                # The scale does not change a bucket; it keeps huge and tiny vectors finite.
                keys[at] = bucket_keys(matrix / np.abs(matrix).max(axis=1, keepdims=True), k, tables)
            ends = np.arange(len(vectors) + 1) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))], names=["rep", "keys"])

    return run


def _first_meeting(bucket: int, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether ``bucket`` is the first in which the classes with these keys meet, pair by pair."""
    done, here = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for table in range(a.shape[1] // (k + 1)):
        x, y = (m[:, table * (k + 1):(table + 1) * (k + 1)] for m in (a, b))
        at_x, at_y = (y == x[:, :1]).any(axis=1), (x == y[:, :1]).any(axis=1)
        where = np.where(at_x & at_y, np.minimum(x[:, 0], y[:, 0]), np.where(at_x, x[:, 0], y[:, 0]))
        meets = (at_x | at_y) & ~done
        here |= meets & (where == bucket)
        done |= meets
    return here


def linked_pairs(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine ``least`` or more, in double precision."""
    left = left / np.abs(left).max(axis=1, keepdims=True)
    right = right / np.abs(right).max(axis=1, keepdims=True)
    a, b = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    near = (left / a[:, None]) @ (right / b[:, None]).T >= least - 1e-9
    i, j = np.nonzero(near)
    exact = np.einsum("nd,nd->n", left[i], right[j]) / (a[i] * b[j]) >= least
    return i[exact], j[exact]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


_FOUND = "rep long, links long, tied long"


def _compared(k: int, least: float):
    def cell(key, rows):
        bucket, low, high = key
        rep, mult, chunk = (np.array(x) for x in zip(*(r[:3] for r in rows)))
        keys = np.array([r[3] for r in rows])
        links, tied_to = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for at, matrix in _matrices([r[4] for r in rows]).values():
            own = chunk[at]
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            pairs = []
            for s in range(0, len(left), 512):
                part = left[s:s + 512]
                i, j = linked_pairs(matrix[part], matrix[right], least)
                i, j = part[i], right[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                first = _first_meeting(bucket, keys[at[i]], keys[at[j]], k)
                pairs.append((at[i[first]], at[j[first]]))
            i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            tied_to = np.minimum(tied_to, _forest(len(rows), i, j))
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[tied_to[hit]])], names=["rep", "links", "tied"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, low, high, *row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (bucket, low, high) != now:
                    if len(held) > 1:
                        yield cell(now, held)
                    now, held = (bucket, low, high), []
                held.append(row)
        if len(held) > 1:
            yield cell(now, held)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept."""
    inf = float("inf")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = (F.col("v").isNotNull()
            & F.forall("v", lambda x: F.coalesce((x < inf) & (x > -inf), F.lit(False))) & F.exists("v", lambda x: x != 0))
    valid = rows.filter(F.coalesce(good, F.lit(False)))
    classes = staged(valid.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("mult"))
                     .withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n, dimensions = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    k = max(1, round(np.log(max(n, 1) / BUCKET_ROWS) / np.log(128)))
    signed = staged(classes.select("rep", "v").mapInArrow(_signed(k, tables_needed(k, dimensions, least)), "rep long, keys array<long>"), "buckets")

    light = signed.select("rep", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = light.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    work = (light.join(sizes.select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "bucket")
            .select("rep", "bucket", own.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")))
    cells = work.select("rep", "bucket", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    dealt = (cells.join(signed, "rep").join(classes, "rep")
             .select("bucket", "low", "high", "rep", "mult", "chunk", "keys", "v")
             .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high"))
    found = staged(dealt.mapInArrow(_compared(k, least), _FOUND), "similar")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("rep").alias("a"), F.col("tied").alias("b")))
    inside = tied.unionAll(tied.select("component", "component").distinct()).toDF("rep", "component")
    named = inside.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
    names = inside.join(named, "component").select("rep", F.col("name"), F.lit(True).alias("tied"))
    per_class = (classes.join(links, "rep", "left").join(names, "rep", "left")
                 .select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                         F.when(F.col("tied"), F.col("name")).otherwise(F.col("least")).alias("component_id")))
    linked = valid.join(per_class, "v").select("id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def query_neardup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
