import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corrag.llm import catalog
from tests_llm_helpers import brute_near_copies, brute_repeats


@pytest.fixture
def folder(spark, documents, prose, table_folder):
    passage = prose(60, 900)
    texts = [prose(40 + i, i) for i in range(60)]
    texts[10] = texts[3]  # an exact copy
    words = texts[40].split()
    words[20] = "changed"
    texts[55] = " ".join(words) + " tail"  # a near copy
    texts[12] += " " + passage
    texts[13] = passage + " " + texts[13]
    texts += [None, "", "12 34 %", " ".join(w + "%%%" for w in prose(60, 70).split())]
    docs = documents(texts, langs=["en"] * 30 + ["en"] * 34)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(63, 0, 0)], "doc_id long, quality int, toxic int")
    return table_folder(documents=docs, labels=labels), dict(enumerate(texts))


def test_every_stage_on_its_own_input(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("extra", F.lit("kept"))
    stages = dict(corpus_pipeline.STAGES)

    docs1 = stages["language_id"](spark, docs, path)
    assert {r.doc_id for r in docs1.collect()} == set(texts) - {60, 61, 62}
    assert docs1.columns == docs.columns

    kept = {r.doc_id: r.text for r in stages["near_copies"](spark, docs1, path).collect()}
    living = {i: t for i, t in texts.items() if i not in (60, 61, 62)}
    assert kept == brute_near_copies(living, 5, 80)
    assert not {10, 55} & set(kept)

    docs2 = docs1.filter(F.col("doc_id").isin(list(kept)))
    cleaned = {r.doc_id: r for r in stages["repeats"](spark, docs2, path).collect()}
    assert {i: r.text for i, r in cleaned.items()} == brute_repeats(kept)
    assert all(r.n_chars == len(r.text) and r.extra == "kept" for r in cleaned.values())

    mixed = stages["mixing"](spark, docs2, path)
    rows = mixed.collect()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in rows} >= set(range(60)) - {10, 55}  # clean documents stay
    assert all(r.text == kept[r.doc_id] for r in rows)

    encoded = stages["encoding"](spark, docs2, path).collect()
    assert len(encoded) == len(kept) and all(r.parity and r.decoded_equal and r.n_tokens == len(r.ids) for r in encoded)


def test_run(spark, folder):
    path, texts = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} >= set(range(60)) - {10, 55}
    assert not {r.doc_id for r in rows} & {10, 55, 60, 61, 62}


def test_empty_tables(spark, documents, table_folder):
    path = table_folder(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_rows_with_null_and_repeated_ids_stay(spark, documents, prose, table_folder):
    texts = [prose(40 + i, i) for i in range(30)]
    docs = documents(texts, ids=[None if i % 5 == 0 else 7 if i % 5 == 1 else i for i in range(30)])
    path = table_folder(labels=spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int"))
    stages = dict(corpus_pipeline.STAGES)
    want = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    for name in ("repeats", "mixing"):
        rows = stages[name](spark, docs, path)
        assert rows.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in rows.collect()) == want, name
