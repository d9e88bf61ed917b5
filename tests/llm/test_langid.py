import random

import numpy as np

from corrag.llm import langid

TONGUES = {"aa": "bala mora keta", "bb": "strif groch plunk", "çç": "élou çâtre nuît"}


def texts(n, seed):
    rng, out, langs = random.Random(seed), [], []
    for _ in range(n):
        lang = rng.choice(list(TONGUES))
        parts = TONGUES[lang].split()
        out.append(" ".join(rng.choice(parts)[:rng.randint(2, 5)] + rng.choice(parts) for _ in range(30)))
        langs.append(lang)
    return out, langs


def test_held_out_accuracy_and_undetermined(spark, documents):
    made, langs = texts(300, 1)
    rows = documents(made + [None, "", "123 %%% 4", made[0]], langs=langs + ["aa"] * 4, lang_pred=["x"] * 304, score=["y"] * 304)
    held = langid.held_out(rows["doc_id"])
    out = {r.doc_id: r for r in langid.predict(rows, langid.fit(rows.filter(~held)), ).collect()}
    assert sum(out[i].lang_pred == langs[i] for i in range(300)) >= 297
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [(out[i].lang_pred, out[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert (out[303].lang_pred, out[303].score) == (out[0].lang_pred, out[0].score)


def test_no_labels_and_empty_table(spark, documents):
    rows = documents(["some text"], langs=[None])
    model = langid.fit(rows)
    assert [r.lang_pred for r in langid.predict(rows, model).collect()] == ["und"]
    assert langid.predict(documents([]), langid.fit(documents([]))).count() == 0


def test_a_long_text_scores_like_its_parts(monkeypatch):
    """Blocks change no count: a text far longer than a block is scored whole."""
    made, _ = texts(40, 2)
    long = " ".join(made)
    whole = langid.count_ngrams([long])
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 2))
    score = langid.score_texts([long, "x"], table)
    monkeypatch.setattr(langid, "BLOCK", 257)
    assert (langid.count_ngrams([long]) == whole).all()
    assert np.allclose(langid.score_texts([long, "x"], table), score)
