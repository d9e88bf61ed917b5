import random

import pytest
from pyspark.sql import functions as F

from corrag.llm import mixing


@pytest.fixture
def corpus(spark, documents, prose):
    rng, texts, domains = random.Random(4), [], []
    for i in range(240):
        domain = rng.choice(["high"] * 6 + ["low"] * 2 + ["toxic"])
        words = prose(rng.randint(30, 90), i).split()
        if domain == "toxic":
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyword"])
        texts.append(" ".join(w + "%%%" for w in words) if domain == "low" else " ".join(words))
        domains.append(domain)
    labelled = spark.createDataFrame([(i, d) for i, d in enumerate(domains) if i % 2], "doc_id long, domain string")
    return documents(texts + [None, "", texts[0]], rate=["r"] * 243, copies=["c"] * 243), labelled, domains


def totals(rows, domains, rate):
    return [sum(r.n_tokens * r.posterior[d] * rate(r) for r in rows) for d in range(domains)]


def test_posteriors_and_totals(corpus):
    docs, labelled, domains = corpus
    targets = {"high": 0.7, "low": 0.2, "toxic": 0.1}
    rows = {r.doc_id: r for r in mixing.mix_documents(docs, labelled, targets).collect()}
    names = sorted(targets)
    held = [i for i in range(0, 240, 2)]
    right = sum(names[max(range(3), key=lambda d: rows[i].posterior[d])] == domains[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows.values())
    whole = sum(r.n_tokens for r in rows.values())
    for got, name in zip(totals(rows.values(), 3, lambda r: r.rate), names):
        assert abs(got - whole * targets[name]) <= mixing.TOLERANCE * whole * targets[name]
    assert rows[240].n_tokens == rows[241].n_tokens == 0
    assert (rows[242].posterior, rows[242].rate) == (rows[0].posterior, rows[0].rate)


def test_an_anchor_keeps_its_total(corpus):
    docs, labelled, _ = corpus
    rows = mixing.mix_documents(docs, labelled, {"high": 0.9, "low": 0.08, "toxic": 0.02}, anchor="high").collect()
    natural, mixed = totals(rows, 3, lambda r: 1.0), totals(rows, 3, lambda r: r.rate)
    assert abs(mixed[0] - natural[0]) <= 2e-3 * natural[0]
    assert abs(mixed[2] / mixed[0] - 2 / 90) < 1e-3


def test_rates_cannot_go_below_zero(corpus):
    docs, labelled, _ = corpus
    rows = mixing.mix_documents(docs, labelled, {"high": 1.0, "low": 0.0, "toxic": 0.0}).collect()
    assert min(r.rate for r in rows) == 0.0


def test_no_labels_one_domain_and_empty(spark, documents, prose):
    none = spark.createDataFrame([], "doc_id long, domain string")
    docs = documents([prose(20, 1), prose(20, 2)])
    assert [r.copies for r in mixing.mix_documents(docs, none, {"a": 1.0}).collect()] == [1, 1]
    rates = [r.rate for r in mixing.mix_documents(docs, none, {"a": 1.0}, total_tokens=80).collect()]
    assert rates == pytest.approx([2.0, 2.0], rel=2e-3)
    assert mixing.mix_documents(documents([]), none).count() == 0


def test_labels_name_domains(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 0), (None, None)], "q int, t int")
    named = [r[0] for r in rows.select(mixing.label_domain(F.col("q"), F.col("t"))).collect()]
    assert named == ["toxic", "high", "low", None, None]
