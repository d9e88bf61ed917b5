import re
from collections import Counter

from corrag.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, documents, prose):
    texts = ["a b c a b c", "a a a a", "x\n \nx\nx y", "one two # $|", "", None, " \t\n", "ß ü 漢字 &&", "a b c d " * 40,
             prose(2000, 1) + " " + prose(300, 1)[:900], "p q r s p q t u v p q r"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = {r.doc_id: tuple(r[n] for n in names) for r in quality.count_text(documents(texts)).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_fences_follow_the_group(spark, documents, prose):
    """A share that is usual in one language is out of range in another."""
    usual = [prose(80, i) for i in range(60)]
    odd = [" ".join(w + "%%" for w in prose(80, 100 + i).split()) for i in range(60)]
    texts = usual + odd + [odd[0], "short", None]
    langs = ["en"] * 60 + ["xx"] * 60 + ["en", "en", None]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(documents(texts, langs=langs)).collect()}
    assert [kept[i] for i in range(123)] == [True] * 120 + [False] * 3


def test_small_groups_borrow_and_empty_tables_pass(spark, documents, prose):
    texts = [prose(80, i) for i in range(40)] + [" ".join(w + "#" * 9 for w in prose(80, 50).split())]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(documents(texts, langs=["en"] * 40 + [None])).collect()}
    assert kept[40] is False and all(kept[i] for i in range(40))
    few = quality.quality_rules(documents(texts[:2] + texts[40:]))
    assert [r.kept for r in few.collect()] == [True] * 3  # too few rows for fences
    assert quality.quality_rules(documents([])).count() == 0
