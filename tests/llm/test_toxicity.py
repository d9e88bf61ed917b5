import random
import re

import numpy as np
import pytest

from corrag.llm import toxicity

INSULTS = ["worthless", "scumbag", "loser", "moronic", "moron"]


def plain_features(text):
    """Prefixes and whole words of a text, letter by letter."""
    found = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for k in range(2, min(8, len(word)) + 1):
            if k >= 3:
                found.add(word[:k])
            if k == len(word):
                found.add(word + "$")
    return found


def some_texts(prose, n=600, seed=3):
    rng, texts, toxic = random.Random(seed), [], []
    for i in range(n):
        words = prose(rng.choice([5, 40, 200]), 100 * seed + i).split()
        bad = rng.random() < 0.2
        for _ in range(rng.choice([1, 3, 5]) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ",", ".", "!"]))
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, toxic


def test_features_equal_plain_ones(prose):
    texts = [prose(30, 1), None, "", "12 !?", "Ab ab a", "été éTÉ naïveté", "x" * 50, "one_two three4four", prose(3, 2) * 3]
    rows, kinds = toxicity.features(texts)
    assert [int((rows == i).sum()) for i in range(len(texts))] == [len(plain_features(t)) for t in texts]
    again, same = toxicity.features([texts[0], texts[0].upper()])
    assert np.array_equal(same[again == 0], same[again == 1])


def test_blocks_do_not_change_features(prose, monkeypatch):
    texts = [prose(400, 5), "", prose(3, 6), "word" * 100 + " end"]
    whole = toxicity.features(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    parts = toxicity.features(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def plain_risk(w, x, positive, prior):
    g = x @ w[:-1] + w[-1]
    clean = np.logaddexp(0, g[~positive]).mean() - prior * np.logaddexp(0, g[positive]).mean()
    return prior * np.logaddexp(0, -g[positive]).mean() + max(0.0, clean)


def test_training_lowers_the_non_negative_risk():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.2
    x = (rng.random((3000, 12)) < np.where(truth[:, None], [0.6] * 4 + [0.3] * 8, [0.02] * 4 + [0.3] * 8)).astype(float)
    confirmed = np.flatnonzero(truth)[:200]
    both = np.concatenate((x[confirmed], x))
    positive = np.arange(len(both)) < 200
    rows, kinds = np.nonzero(both)
    w = toxicity.train(rows, kinds, positive, 12, 0.2, decay=0.0)
    best = plain_risk(w, both, positive, 0.2)
    assert all(best <= plain_risk(w + rng.normal(0, 0.3, 13), both, positive, 0.2) + 1e-3 for _ in range(50))
    assert (((x @ w[:-1] + w[-1]) > 0) == truth).mean() > 0.93


def test_held_out_texts_are_told_apart(spark, documents, prose, table_folder):
    texts, toxic = some_texts(prose)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 2], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.query_toxicity(spark, table_folder(documents=documents(texts), labels=labels)).collect()}
    assert len(found) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    for bad, least in ((True, 0.9), (False, 0.95)):
        mine = [r.predicted == bad for r in found.values() if r.held_out and toxic[r.doc_id] == bad]
        assert sum(mine) >= least * len(mine)


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents, prose, tmp_path):
    texts, toxic = some_texts(prose, 200, 4)
    scores = []
    for k, flip in enumerate((False, True)):
        folder = tmp_path / str(k)
        rows = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
        if flip:
            from pyspark.sql import functions as F
            rows = rows.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
        documents(texts).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        rows.write.parquet(f"{folder}/labels.parquet")
        scores.append({r.doc_id: round(r.score, 9) for r in toxicity.query_toxicity(spark, str(folder)).collect()})
    assert scores[0] == scores[1]


@pytest.mark.parametrize("confirmed", [[], [0, 0, None, 2]])
def test_odd_rows(spark, documents, prose, table_folder, confirmed):
    texts = ["moron " + prose(5, 1), None, "moron moron", "", "123", prose(10, 2), prose(10, 2)]
    docs = documents(texts, ids=[0, 1, 2, None, None, 5, 5], score=["x"] * 7, _yes=["y"] * 7)
    labels = spark.createDataFrame([(i, 1) for i in confirmed], "doc_id long, toxic int")
    found = toxicity.query_toxicity(spark, table_folder(documents=docs, labels=labels)).collect()
    assert len(found) == 7 and all(r.score is not None and r.held_out is not None for r in found)
    if not confirmed:
        assert all(r.score == 0 for r in found)


def test_empty_tables(spark, documents, table_folder):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.query_toxicity(spark, table_folder(documents=documents([]), labels=labels)).count() == 0
