import numpy as np
import pytest
from pyspark.sql import functions as F

from corrag.llm import neardup


def brute(vectors, least):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(vectors)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good(vectors[i]) and good(vectors[j]) and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                linked[i, j] = linked[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in np.flatnonzero(linked[i])]) for i in range(n)]
        if new == label:
            return linked.sum(axis=1).tolist(), label
        label = new


def run(spark, vectors, **more):
    rows = [(i, v, *(c[i] for c in more.values())) for i, v in enumerate(vectors)]
    extra = "".join(f", {name} string" for name in more)
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}").repartition(4)
    found = {r.vec_id: r for r in neardup.near_duplicates(frame).collect()}
    assert set(found) == set(range(len(vectors)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    return [found[i].n_links for i in range(len(vectors))], [found[i].component_id for i in range(len(vectors))]


@pytest.mark.parametrize("dimensions,chunk", [(64, 2048), (20, 16)])
def test_equals_all_pairs(spark, monkeypatch, dimensions, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)  # the second run cuts buckets into chunks
    rng, vectors = np.random.default_rng(dimensions), []
    for _ in range(40):
        centre = rng.normal(size=dimensions)
        for noise in [0.0] + [0.17] * int(rng.integers(0, 6)):
            vectors.append([float(np.float32(x)) for x in centre + noise * rng.normal(size=dimensions)])
    vectors += [vectors[3], vectors[3], [2 * x for x in vectors[3]]]
    got, want = run(spark, vectors, rep=["r"] * len(vectors), links=["l"] * len(vectors)), brute(vectors, 0.95)
    missed = sum(want[0]) - sum(got[0])
    assert 0 <= missed <= 0.02 * sum(want[0]) and all(g <= w for g, w in zip(got[0], want[0]))
    assert missed or got[1] == want[1]


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [1.0, inf], [1.0, nan], [1e-30, 1e-30], [1e30, 1e30], [1.0], [2.0], [1.0, 1.0]]
    assert run(spark, vectors) == ([0] * 7 + [2, 2, 1, 1, 2], [0, 1, 2, 3, 4, 5, 6, 7, 7, 9, 9, 7])


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x, y, z, w = (rng.normal(size=16) for _ in range(4))
    rows = [(None, x), (2, x + 0.01 * y), (1, y), (1, z), (3, z + 0.01 * x), (3, z + 0.01 * x),
            (None, w), (None, w), (None, w + 0.01 * x), (7, None), (None, None)]
    frame = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in neardup.near_duplicates(frame).select(
        F.coalesce("vec_id", F.lit(-1)), "n_links", F.coalesce("component_id", F.lit(-1)), "kept").collect())
    assert found == sorted([
        (-1, 1, 2, False), (2, 1, 2, True), (1, 0, 1, True), (1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False),
        (-1, 2, -1, True), (-1, 2, -1, True), (-1, 2, -1, True), (7, 0, 7, True), (-1, 0, -1, True)])


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(neardup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neardup.hadamard(neardup.hadamard(x)), x)


@pytest.mark.parametrize("k", [2, 3])
def test_links_at_the_threshold_are_found_at_every_k(spark, monkeypatch, k):
    rng, vectors = np.random.default_rng(k), []
    for _ in range(300):
        x, y = rng.normal(size=(2, 64))
        y -= x * (x @ y) / (x @ x)
        y *= np.linalg.norm(x) / np.linalg.norm(y)
        vectors += [x.tolist(), (0.951 * x + np.sqrt(1 - 0.951 ** 2) * y).tolist()]
    monkeypatch.setattr(neardup, "BUCKET_ROWS", len(vectors) / 128 ** k)  # the size of table that needs k
    got, want = run(spark, vectors), brute(vectors, 0.95)
    assert sum(want[0]) == 600 and 594 <= sum(got[0]) <= 600
