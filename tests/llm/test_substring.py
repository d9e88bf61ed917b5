import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corrag.llm import substring
from corrag.llm.fmindex import FMIndex, repeated_windows
from corrag.llm.shingles import BLOCK
from corrag.session import TEXT_BATCH, staged

W = substring.WINDOW


def brute(texts):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen = Counter(tuple(w[j:j + W]) for w in words.values() for j in range(len(w) - W + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - W + 1):
            if seen[tuple(w[j:j + W])] > 1:
                gone[j:j + W] = [True] * W
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(prose, seed):
    rng = random.Random(seed)
    shared = [prose(n, seed * 100 + n) for n in (20, 34, 35, 36, 50, 120)]
    texts = []
    for i in range(60):
        parts = [prose(rng.choice([0, 1, 10, 60]), seed * 1000 + i * 10 + k) for k in range(3)]
        for k in range(2):
            if rng.random() < 0.5:
                parts.insert(k + 1, rng.choice(shared))
        texts.append("\n".join(p for p in parts if p))
    texts += [None, "", " ", "word", texts[3], texts[3], "again " * 80, "a b " * 40, prose(34, 1), prose(34, 1), prose(35, 2), prose(35, 2)]
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 3)])
def test_equals_counting_all_windows(spark, documents, prose, monkeypatch, seed, hot):
    monkeypatch.setattr(substring, "HOT", hot)  # the second run deals windows one by one
    texts = passages(prose, seed)
    found = substring.repeat_digest(documents(texts)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(dict(enumerate(texts)))


def test_removal_keeps_other_columns_and_untouched_texts(spark, documents, prose):
    passage = prose(60, 5)
    texts = [f"start one {passage} end", f"{passage} two", "left  as\tit is", None]
    docs = documents(texts, runs=["a", "b", "c", "d"], id=["1", None, "3", "4"])
    found = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert [found[i].text for i in range(4)] == ["start one end", "two", "left  as\tit is", None]
    assert [found[i].runs for i in range(4)] == ["a", "b", "c", "d"] and found[1].id is None


def test_empty_table(spark, documents):
    assert substring.repeat_digest(documents([])).count() == 0
    assert substring.remove_repeats(documents([])).count() == 0


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lines = [rng.integers(1, 4, rng.integers(1, 15)) for _ in range(rng.integers(1, 6))]
        weights, window = rng.integers(1, 3, len(lines)), int(rng.integers(2, 6))
        symbols = np.concatenate([np.append(s, 0) for s in lines])
        ends = np.cumsum([len(s) + 1 for s in lines]) - 1
        starts = ends - [len(s) for s in lines]
        index = FMIndex(symbols, np.repeat(weights, [len(s) + 1 for s in lines]), 16)
        seen = Counter()
        for s, w in zip(lines, weights):
            for i in range(len(s) - window + 1):
                seen[tuple(s[i:i + window])] += w
        want = np.zeros(len(symbols), bool)
        for s, a in zip(lines, starts):
            for i in range(len(s) - window + 1):
                want[a + i] = seen[tuple(s[i:i + window])] >= 2
        assert (repeated_windows(index, symbols, starts, ends, window, 2) == want).all()


def test_null_and_repeated_ids(spark, documents, prose):
    passage = prose(60, 5)
    texts = [f"one {passage}", f"{passage} two", prose(50, 6), f"three {passage} four", prose(40, 7), prose(40, 7), None]
    ids = [None, 4, None, 4, 4, 4, None]
    want = brute(dict(enumerate(texts)))
    found = [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring.repeat_digest(documents(texts, ids=ids)).collect()]
    assert sorted(found, key=repr) == sorted(((i, want[k]) for k, i in enumerate(ids)), key=repr)
    kept = [(r.doc_id, r.text) for r in substring.remove_repeats(documents(texts, ids=ids)).collect()]
    assert sorted(kept, key=repr) == sorted(zip(ids, ["one", "two", texts[2], "three four", "", "", None]), key=repr)


def test_rows_of_files_have_numbers_of_their_own(spark, documents, prose, tmp_path):
    """Rows of a Parquet table are named by file and place, whatever their ids and extra columns; others by a copy."""
    from corrag.llm.common import numbered

    rows = documents([prose(10, i) for i in range(40)], ids=[7] * 40, _metadata=[str(i) for i in range(40)])
    rows.repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for table in (docs, docs.filter("text is not null"), docs.limit(0)):
        first, again = (dict(r) for r in ([(x["_row"], x["text"]) for x in t.collect()] for t in [numbered(table, "_row")] * 2))
        assert first == again and len(first) == table.count()
    assert numbered(docs, "_row").columns == [*docs.columns, "_row"]


def test_a_worker_holds_a_slice_of_a_batch(prose):
    def peak(texts):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["id", "text", "name"])
        tracemalloc.start()
        rows = sum(found.num_rows for found in substring._describe([batch]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts)
        return most

    texts = [prose(8000, i) for i in range(8)] * 40
    peak(texts[:40])  # tables that stay
    assert peak(texts) < 1.2 * peak(texts[:40])


def test_cuts_come_slice_by_slice(prose):
    text = prose(20_000, 1)
    cut = {"anchor": 1, "piece": 2, "weight": 2, "at": 0, "n": 19_000, "hot": False}
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 20), pa.array([[cut]] * 20)], names=["text", "cuts"])
    found = list(substring._cut(8)([batch]))
    assert sum(b.num_rows for b in found) == 20
    assert max(b.nbytes for b in found) < 2 * BLOCK


def test_staged_steps_bound_the_bytes_of_a_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    long = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) AS text").mapInArrow(sizes, "n long")
    assert staged(long, "sizes", TEXT_BATCH).selectExpr("max(n)").first()[0] < 1.1 * TEXT_BATCH
    assert spark.conf.get(key) == own
    assert staged(long, "sizes").selectExpr("max(n)").first()[0] > 4 * TEXT_BATCH
