import random
import zlib

import pytest

from corrag.llm import sharding


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        capacity, n, held = (low + high) // 2, 1, 0
        for size in sizes:
            if held + size > capacity:
                n, held = n + 1, 0
            held += size
        low, high = (low, capacity) if n <= shards else (capacity + 1, high)
    return low


@pytest.mark.parametrize("seed,copies", [(1, 1), (2, 40)])
def test_minimax_slots_and_groups(spark, documents, seed, copies):
    rng = random.Random(seed)
    texts = ["é" * rng.randint(0, 300) + str(rng.random()) for _ in range(150)] + [None, "", None, ""]
    texts += [texts[7]] * copies + ["x" * 4000]
    rng.shuffle(texts)
    rows = sharding.shard_documents(documents(texts, shard=["s"] * len(texts), bytes=["b"] * len(texts))).collect()
    assert len(rows) == len(texts)
    totals, shard_of, groups = {}, {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        totals[r.shard] = totals.get(r.shard, 0) + r["size"]
        groups[texts[r.doc_id]] = groups.get(texts[r.doc_id], 0) + r["size"]
    assert max(totals.values()) == smallest_capacity(list(groups.values()), 8) == rows[0].capacity
    for shard in totals:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert set(totals) <= set(range(8))


def test_few_groups_and_empty_table(spark, documents):
    rows = sharding.shard_documents(documents(["a", "a", "b"], ids=[5, 5, 6])).collect()
    assert {(r.doc_id, r.shard) for r in rows} == {(5, 0), (6, 1)}
    assert sorted(r.slot for r in rows if r.shard == 0) == [0, 1]
    assert sharding.shard_documents(documents([])).count() == 0
