import os
import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in "nrstl"]


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def prose():
    """``prose(n, seed)``: n words without much repetition."""
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(texts, **columns)``: a table with doc_id, text, lang, source, n_chars and more."""
    def make(texts, ids=None, langs=None, **more):
        rows = [(i, t, lang, f"s{k % 3}", None if t is None else len(t), *(v[k] for v in more.values()))
                for k, (i, t, lang) in enumerate(zip(ids or range(len(texts)), texts, langs or ["en"] * len(texts)))]
        extra = "".join(f", {name} string" for name in more)
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}").repartition(4)

    return make


@pytest.fixture
def table_folder(tmp_path):
    """``table_folder(documents=df, ...)``: a folder of Parquet tables for a query."""
    def make(**tables):
        for name, frame in tables.items():
            frame.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return make
