import random

import numpy as np
import pytest

from corrag.llm import ngram_join


def brute_components(texts, size, percent):
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split() if text else []
        sets[i] = {tuple(words[j:j + size]) for j in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(prose, seed):
    """Texts of many sizes with edits that put pairs on both sides of the threshold, and chains of edits."""
    rng, texts = random.Random(seed), []
    for k in range(24):
        words = prose(rng.choice([3, 5, 9, 20, 60, 150, 400]), 1000 * seed + k).split()
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 4, 8])):
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(words) // 60)])):
                at = rng.randrange(len(words))
                kind = rng.random()
                if kind < 0.5:
                    words[at] = "edit" + str(rng.random())
                elif kind < 0.8:
                    words.insert(at, "new")
                elif len(words) > 3:
                    del words[at]
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("size,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_equals_all_pairs(spark, documents, prose, size, percent, seed):
    texts = near_copies(prose, seed)
    common = prose(50, 77)  # a passage of many texts
    texts += [prose(40 + i, 500 + i) + " " + common for i in range(20)]
    texts += [None, "", "  \n", "One", "one", "one two", "ONE two", texts[0], texts[0].upper()]
    found = ngram_join.jaccard_components(documents(texts), size, percent).collect()
    want = brute_components(dict(enumerate(texts)), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_large_group_of_near_copies(spark, documents, prose):
    base = prose(200, 5).split()
    texts = [" ".join(base[:i % 190] + [f"x{i}"] + base[i % 190 + 1:]) for i in range(150)] + [prose(100, i) for i in range(20)]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(texts)).collect()}
    assert found == {i: c for i, (_, c) in brute_components(dict(enumerate(texts)), 3, 90).items()}


def test_unlinked_neighbours_of_a_group_stay_out(spark, documents, prose):
    """A text that shares most tokens with a group but links with no member keeps its own component."""
    base = prose(120, 8).split()
    far = base[:100] + prose(20, 9).split()
    found = ngram_join.jaccard_components(documents([" ".join(base), " ".join(base[:-1]), " ".join(far)])).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 0, 2: 2}


def test_empty_table_and_extra_columns(spark, documents, prose):
    assert ngram_join.jaccard_components(documents([])).count() == 0
    docs = documents([prose(30, 1)] * 2, component_id=["a", None], rep=["x", "y"], token=["1", "2"])
    assert {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()} == {(0, 0), (1, 0)}


def test_repeated_rows(spark, documents, prose):
    found = ngram_join.jaccard_components(documents([prose(30, 1)] * 2 + [prose(30, 2)], ids=[4, 4, 9])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(4, 4), (4, 4), (9, 9)]


def test_family_below_the_threshold(spark, documents, prose):
    """Similar texts of which hardly any two link meet by parts: the candidates stay few."""
    rng, base = random.Random(3), prose(300, 12).split()
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(len(words)), 6):
            words[at] = f"w{i}x{at}"
        texts.append(" ".join(words))
    texts += [texts[3] + " tail", texts[50] + " tail", texts[50]]
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(texts)).collect()}
    assert found == {i: c for i, (_, c) in brute_components(dict(enumerate(texts)), 3, 90).items()}


@pytest.mark.parametrize("rows,elements", [(4, 1 << 18), (256, 300)])
def test_small_parts_lose_no_link(spark, documents, prose, monkeypatch, rows, elements):
    monkeypatch.setattr(ngram_join, "PART_ROWS", rows)
    monkeypatch.setattr(ngram_join, "PART_ELEMENTS", elements)
    texts = near_copies(prose, 6)
    found = ngram_join.jaccard_components(documents(texts), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(dict(enumerate(texts)), 5, 80)


def test_repeated_and_null_ids(spark, prose):
    z, w, u = prose(60, 21), prose(60, 22), prose(60, 23)
    rows = [(1, z), (1, w), (2, w + " more"), (None, w), (None, u), (7, u + " more"), (None, z + " " + u), (None, None), (4, None), (2, w + " more")]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == sorted([(1, 58, 1), (1, 58, 1), (2, 59, 1), (2, 59, 1), (None, 58, 1), (None, 58, 7), (7, 59, 7), (None, 118, None),
                          (None, 0, None), (4, 0, 4)], key=str)


def recorded(monkeypatch):
    """The rows of the staged tables of the join by name."""
    tables, staged = {}, ngram_join.staged

    def record(frame, name):
        found = staged(frame, name)
        tables.setdefault(name, []).extend(r.asDict() for r in found.collect())
        return found

    monkeypatch.setattr(ngram_join, "staged", record)
    return tables


def test_texts_of_a_common_passage_share_parts(spark, documents, prose, monkeypatch):
    """Texts that have a passage in common, and no links, meet by few parts; tokens are stored nowhere."""
    passage = prose(60, 31)
    texts = [prose(45 + i % 5, 900 + i) + " " + passage for i in range(240)]
    texts += [texts[7] + " tail", texts[100].replace(" ", " new ", 1)]
    tables = recorded(monkeypatch)
    found = ngram_join.jaccard_components(documents(texts), 5, 80).collect()
    want = brute_components(dict(enumerate(texts)), 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    parts = [r["part"] for r in tables["parts"]]
    assert len(parts) > 100 and len(set(parts)) < len(parts) / 4
    assert not any("tokens" in row for row in tables["sets"])
    assert len(tables["close"]) < 20  # sets whose elements travel


def test_sketches_never_differ_in_more_places_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 1000, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 9:], rng.integers(0, 1 << 63, n // 7 + 1, dtype=np.uint64)))
        k = int(np.searchsorted(ngram_join.BOUNDS, n, "right")) - 1
        apart = np.bitwise_count(ngram_join.sketch(a, k) ^ ngram_join.sketch(b, k)).sum()
        assert apart <= len(np.setxor1d(a, b))
        assert ngram_join.sketch(a, k).tobytes() == ngram_join.sketch(a[::-1], k).tobytes()


@pytest.mark.parametrize("asking", [1, 3])
def test_many_slots_lose_no_link(spark, documents, prose, monkeypatch, asking):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 2)
    monkeypatch.setattr(ngram_join, "ASKING_ROWS", asking)
    texts = near_copies(prose, 9)
    found = ngram_join.jaccard_components(documents(texts), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(dict(enumerate(texts)), 3, 80)
