import random
import re
from collections import Counter

import pytest

from corrag.llm import collocations


def plain(rows, threshold, best, factor=2_000_000, covered=80):
    """Collocations by counting every phrase of every length at once."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = tuple(re.findall(r"[^ \t]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= threshold}
    inside = Counter()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i:i + m]
                inside[key] = max(inside[key], a)
    for (lang, words), a in candidates.items():
        if inside[lang, words] and 100 * inside[lang, words] >= covered * a:
            continue
        score, k, l, r = min((factor * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                             for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks, rows = Counter(), set()
    for lang, phrase, a, l, r, total, score in out:
        ranks[lang] += 1
        if ranks[lang] <= best:
            rows.add((lang, ranks[lang], phrase, a, l, r, total, score))
    return rows


def found(docs, **settings):
    return {(x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in collocations.collocations(docs, **settings).collect()}


def some_texts(seed, n=120):
    """Texts over few words, with phrases that often come together and get frequent late in the table."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["Ä", "é", "x-y", "New", "york", "city", "hall"]
    texts = []
    for i in range(n):
        out = []
        for _ in range(rng.choice([1, 5, 30, 60])):
            out.append("New York City hall" if rng.random() < 0.04 + 0.001 * i else rng.choice(words))
            if rng.random() < 0.1:
                out[-1] += rng.choice([",", ".", "\n", " \t", "!?", " z"])
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize("seed,threshold,best", [(1, 3, 2000), (2, 5, 25)])
def test_equals_counting_all(spark, documents, seed, threshold, best):
    texts = some_texts(seed) + [None, "", " .,\n", "one"] + ["big apple, big apple"] * 5
    langs = [["en", None, "und", "de"][i % 4] if i % 3 else "en" for i in range(len(texts))]
    docs = documents(texts, langs=langs)
    assert found(docs, threshold=threshold, best=best) == plain(list(zip(texts, langs)), threshold, best)


def test_blocks_and_small_slot_tables(spark, documents, monkeypatch):
    """Long texts in parts, many flushes and many phrases in one slot change nothing."""
    texts = [" ".join(some_texts(5, 40)), "a b c " * 300 + "." + "b c a " * 50, "x" * 500]
    want = plain([(t, "en") for t in texts], 5, 2000)
    for name, value in {"BLOCK": 200, "COUNTED": 64}.items():
        monkeypatch.setattr(collocations, name, value)
    assert list(collocations._parts(b"ab " * 200)) != [b"ab " * 200]
    batch_texts = [collocations.lowered(t) for t in texts]
    import numpy as np
    for raw in batch_texts:
        seeds = np.array([7], np.uint64)
        _, _, piece, hashes = collocations._seeded(seeds, [raw])
        monkeypatch.setattr(collocations, "BLOCK", 1 << 20)
        _, _, whole_piece, whole = collocations._seeded(seeds, [raw])
        monkeypatch.setattr(collocations, "BLOCK", 200)
        assert np.array_equal(hashes, whole) and np.array_equal(np.diff(piece) > 0, np.diff(whole_piece) > 0)
    monkeypatch.setattr(collocations, "FEWEST_SLOTS", 1 << 10)
    monkeypatch.setattr(collocations, "MOST_SLOTS", 1 << 10)
    assert found(documents(texts), threshold=5) == want


def test_counts_beyond_a_byte_and_ties(spark, documents):
    texts = ["red car"] * 700 + ["blue car"] * 300 + ["red bus"] * 300
    assert found(documents(texts), threshold=30) == plain([(t, "en") for t in texts], 30, 2000)


def test_empty_table_and_clashing_columns(spark, documents):
    assert found(documents([])) == set()
    texts = ["green tea"] * 4
    docs = documents(texts, phrase=["x"] * 4, score=["y"] * 4, h=["z"] * 4)
    assert found(docs, threshold=2) == plain([(t, "en") for t in texts], 2, 2000)
