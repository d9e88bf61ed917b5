"""Column functions on small hand-made values."""

import pytest
from pyspark.sql import functions as F

from corrag.functions import rules
from corrag.functions.text import count_tokens, sentences, split_tokens, truncate_tokens
from corrag.functions.vectors import cosine, l2_normalize


def values(spark, column, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("n,starts", [
    (0, [0]), (1, [0]), (512, [0]), (513, [0, 448]), (960, [0, 448]), (961, [0, 448, 896]),
    (2000, [0, 448, 896, 1344, 1792])])
def test_windows_start_every_448_and_stop_at_the_end(spark, n, starts):
    text = " ".join(str(i) for i in range(n))
    windows = values(spark, split_tokens(F.col("t")), [text])[0]
    assert len(windows) == len(starts)
    if n:
        assert [int(w.split()[0]) for w in windows] == starts
        assert int(windows[-1].split()[-1]) == n - 1
        assert all(len(w.split()) <= 512 for w in windows)


def test_windows_are_substrings_and_empty_text_is_one_window(spark):
    text = "a  b\n\nc\td"
    windows = values(spark, split_tokens(F.col("t"), 3, 1), [text, "", "   "])
    assert windows == [["a  b\n\nc", "\n\nc\td"], [""], ["   "]]


def test_truncation_keeps_short_text_as_it_is(spark):
    assert values(spark, truncate_tokens(F.col("t"), 2), [" a  b ", "a  b c"]) == [" a  b ", "a  b"]
    assert values(spark, count_tokens(F.col("t")), ["", " a\nb "]) == [0, 2]


def test_sentences(spark):
    assert values(spark, sentences(F.col("t")), [" One. Two!  Three?four ", ""]) == [
        ["One.", "Two!", "Three?four"], []]


def test_vectors(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<double>, b array<double>")
    assert [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>")
    assert [r[0] for r in unit.select(l2_normalize(F.col("a"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("message,mode,verdict,intent", [
    ("", "ask", None, "chat"),
    ("  hi there! ", "ask", "research", "chat"),
    ("Good   morning", "deep_dive", None, "chat"),
    ("hi, what is attention", "ask", None, "research"),
    ("what do these papers say", "ask", "chat", "clarify"),
    ("what does this paper say", "deep_dive", None, "research"),
    ("the above paper", "ask", None, "clarify"),
    ("paper on thesis papers", "ask", None, "research"),
    ("explain", "ask", " General. ", "general"),
    ("explain", "deep_dive", "general", "research"),
    ("explain", "deep_dive", "CHAT", "chat"),
    ("explain", "ask", "not chat", "research"),
    ("explain", "ask", None, "research")])
def test_intents(spark, message, mode, verdict, intent):
    frame = spark.createDataFrame([(message, mode, verdict)], "m string, d string, v string")
    assert frame.select(rules.classify_intent(F.col("m"), F.col("d"), F.col("v"))).first()[0] == intent


def test_an_assistant_may_be_greeted_by_name(spark):
    assert values(spark, rules.is_chitchat(F.col("t"), "robin"), ["hey robin", "hey rabbit"]) == [True, False]


def test_recency_is_word_bounded(spark):
    texts = ["the latest work", "up-to-date", "State of the art", "sotas", "in 2025?", "12025", "élatest"]
    assert values(spark, rules.wants_recent(F.col("t")), texts) == [True, True, True, False, True, False, False]


def test_equation_only(spark):
    texts = ["short and plain", r"$x$ \alpha", "$$a$$ " + "word " * 40, r"\frac{a}{b}", "costs 5$"]
    assert values(spark, rules.is_equation_only(F.col("t")), texts) == [False, True, False, True, False]


def test_paper_ids(spark):
    good = ["2301.00001", "2301.00001v2", "hep-th/9901001", "math.AG/0309001v2", " 2301.00001 "]
    bad = ["not-an-id", "../etc", "12.3", "", "2301.1"]
    assert values(spark, rules.valid_paper_id(F.col("t")), good + bad) == [True] * 5 + [False] * 5
    assert values(spark, rules.safe_path_id(F.col("t")), ["/../a b/c/", "hep-th/1"]) == ["ab/c", "hep-th/1"]
    links = ["http://arxiv.org/abs/2301.00001v12", "http://arxiv.org/abs/solv-int/9901001v1", "plain"]
    assert values(spark, rules.canonical_paper_id(F.col("t")), links) == [
        "2301.00001", "solv-int/9901001", "plain"]


def test_routes(spark):
    frame = spark.createDataFrame(
        [("ask", True, 1), ("ask", None, 2), ("deep_dive", True, 0), ("deep_dive", False, 3)],
        "m string, s boolean, n int")
    got = [tuple(r) for r in frame.select(
        rules.route_after_grade(F.col("m"), F.col("s")), rules.route_after_corrective(F.col("n"))).collect()]
    assert got == [("generate_ask", "retrieve"), ("ask_corrective", "generate_ask"),
                   ("generate_deep_dive", "retrieve"), ("deep_dive_insufficient", "generate_ask")]
    assert values(spark, rules.route_after_classify(F.col("t")), ["chat", "odd", None]) == [
        "chat", "retrieve", "retrieve"]


def test_white_space_of_every_kind_is_stripped(spark):
    from corrag.functions.text import strip_ws

    rows = spark.createDataFrame([("  　 a b \x85",), ("",)], "t string")
    assert [r[0] for r in rows.select(strip_ws(rows.t)).collect()] == ["a b", ""]
