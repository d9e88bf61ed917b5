"""Context, history, prompts, citations, media, sessions, turns, grades, requests."""

import datetime as dt

from pyspark.sql import functions as F

from corrag.operators.filters import check_requests, grade
from corrag.operators.prompt import (
    assemble_prompts, build_context, citations, media_markdown, trim_history)
from corrag.operators.sessions import (
    ERROR_MESSAGE, RATE_LIMIT_MESSAGE, assemble_turns, chat_history, deep_dive_ready, list_sessions,
    session_visible, sessions_for_client)
from corrag.operators.topk import joined_in_order

SECTIONS = ("query_id string, rank int, paper_id string, paper_title string, published_date string, "
            "abstract string, section_title string, text string, content_type string, media_url string")


def section(rank, text, paper="p", title="T", date="2021-05-06", head="S", kind="text", url=None, query="q"):
    return (query, rank, paper, title, date, "abs" if paper else None, head, text, kind, url)


def context(spark, sections, **kw):
    return [tuple(r)[1:] for r in build_context(spark.createDataFrame(sections, SECTIONS), **kw).collect()]


def test_context_budget(spark):
    words = lambda n: " ".join(["w"] * n)
    label = "[Source: T, 2021] [S]\n"  # four tokens
    assert context(spark, [section(1, words(6)), section(2, words(6))], budget=20) == [
        (f"{label}{words(6)}\n\n{label}{words(6)}", 20, 2)]
    assert context(spark, [section(1, words(6)), section(2, words(7)), section(3, "w")], budget=20, min_tokens=10) == [
        (f"{label}{words(6)}\n\n{label}{words(6)}", 20, 2)]
    assert context(spark, [section(1, words(6)), section(2, words(7)), section(3, "w")], budget=20, min_tokens=11) == [
        (f"{label}{words(6)}", 10, 1)]
    assert context(spark, [section(1, "x", title="", date=None, head=None)]) == [("[Source: p]\nx", 3, 1)]


def test_history(spark, rows):
    said = [("s", i, "user", t) for i, t in enumerate(["a a", "b b b", "", "c", "d d"])] + [("big", 0, "user", "w " * 9)]
    frame = spark.createDataFrame(said, "session_id string, turn long, role string, content string")
    assert rows(trim_history(frame, 5), "session_id", "turn") == [("s", 2), ("s", 3), ("s", 4)]
    assert rows(trim_history(frame, 6), "session_id", "turn") == [("s", 1), ("s", 2), ("s", 3), ("s", 4)]
    assert rows(trim_history(frame, 99), "session_id", "turn")[0] == ("big", 0)
    now = spark.createDataFrame([("s", 2)], "session_id string, turn long")
    assert rows(chat_history(frame, now), "turn") == [(0,), (1,)]
    assert chat_history(frame).count() == 6


def test_prompts(spark):
    queries = spark.createDataFrame(
        [("a", "ask", "research", "hi?"), ("b", "deep_dive", "research", "b?"), ("c", "ask", "general", "c?")],
        "query_id string, mode string, intent string, user_message string")
    ctx = spark.createDataFrame([("a", "CTX"), ("b", ""), ("c", "CTX")], "query_id string, context string")
    past = spark.createDataFrame([("a", 2, "assistant", "y"), ("a", 1, "user", "x")], "query_id string, turn long, role string, content string")
    texts = {"chat": "1", "clarify": "2", "general": "3", "ask": "4", "deep_dive": "5"}
    got = {r.query_id: [(m.role, m.content) for m in r.messages] for r in assemble_prompts(queries, ctx, past, texts, "Data.").collect()}
    assert got["a"] == [("system", "4\n\nData.\n\n<retrieved_context>\nCTX\n</retrieved_context>"), ("user", "x"), ("assistant", "y"), ("user", "hi?")]
    assert got["b"] == [("system", "5"), ("user", "b?")] and got["c"] == [("system", "3"), ("user", "c?")]


def test_citations_and_media(spark, rows):
    sections = spark.createDataFrame([
        section(1, " t ", "p2", kind="table"), section(2, "cap", "p1", None, kind="figure", url="u1"),
        section(3, "t", "p2", kind="table"), section(4, "", "", kind="figure", url="u2"), section(5, "no", "p3", kind="figure"),
        section(6, "cap", "p3", kind="figure", url="u1"), section(7, "z", "p4", "", kind="table")], SECTIONS)
    assert rows(citations(sections), "position", "paper_id", "title") == [(1, "p2", "T"), (2, "p1", ""), (3, "p3", "T"), (4, "p4", "")]
    chat = spark.createDataFrame([("q", "chat")], "query_id string, intent string")
    assert citations(sections, chat).count() == 0
    assert media_markdown(sections).first().markdown == (
        "\n\n**Table — T**\n\nt\n\n![cap](u1)\n\n![Figure](u2)\n\n**Table — p4**\n\nz")
    assert media_markdown(sections, 2).first().n_items == 2
    assert media_markdown(sections.filter("content_type = 'text'")).count() == 0


def test_sessions(spark, rows):
    day = dt.datetime(2024, 1, 1)
    sessions = spark.createDataFrame([
        ("s1", "c", "ask", None, "Saved", day), ("s2", "c", "ask", None, None, day + dt.timedelta(1)),
        ("s3", "c", "deep_dive", "p1", None, day + dt.timedelta(2)), ("s4", "c", "ask", None, None, day + dt.timedelta(3)),
        ("s5", None, "deep_dive", "p2", None, day), ("s6", "d", "deep_dive", "p9", None, day)],
        "session_id string, client_id string, mode string, paper_id string, title string, created_at timestamp")
    messages = spark.createDataFrame(
        [("s2", 0, "assistant", "no"), ("s2", 2, "user", "later"), ("s2", 1, "user", " " + "long\nline " * 9)],
        "session_id string, turn long, role string, content string")
    got = [(r.position, r.session_id, r.title) for r in list_sessions(sessions, messages, "c").orderBy("position").collect()]
    assert got == [(1, "s4", "New chat"), (2, "s3", "Deep Dive · p1"), (3, "s2", ("long line " * 9)[:60] + "…"), (4, "s1", "Saved")]
    assert list_sessions(sessions, messages, "c", limit=1).count() == 1 and list_sessions(sessions, messages).count() == 0
    assert sessions_for_client(sessions, None).count() == 0
    assert rows(sessions.filter(session_visible(F.col("client_id"), None)), "session_id") == [("s5",)]
    assert rows(sessions.filter(session_visible(F.col("client_id"), "d")), "session_id") == [("s5",), ("s6",)]
    papers = spark.createDataFrame([("p1", "full"), ("p2", "pending")], "paper_id string, ingestion_status string")
    assert rows(deep_dive_ready(sessions, papers).filter("NOT ready"), "session_id") == [("s5",), ("s6",)]


def test_turns(spark, rows):
    columns = "session_id string, turn_id long, seq long, type string, content string, arxiv_id string, title string, abstract_snippet string"
    log = [("s", 1, 2, "token", "b"), ("s", 1, 1, "token", "a"), ("s", 1, 1500, "token", "c"), ("s", 1, 3, "citation", None), ("s", 1, 1600, "done", None),
           ("s", 2, 1, "token", "x"), ("s", 2, 2, "done", "final"), ("s", 3, 1, "token", "x"), ("s", 4, 1, "error", "rate_limited"),
           ("s", 5, 1, "error", "boom"), ("s", 5, 2, "citation", None)]
    events = spark.createDataFrame([(*e, "id" if e[3] == "citation" else None, None, None) for e in log], columns)
    messages, cited = assemble_turns(events)
    assert rows(messages, "turn_id", "content") == [(1, "abc"), (2, "final"), (4, RATE_LIMIT_MESSAGE), (5, ERROR_MESSAGE)]
    assert rows(cited, "turn_id", "message_id", "arxiv_id") == [(1, "s/1", "id")]


def test_joined_in_order_over_many_runs(spark):
    frame = spark.range(5000).select(F.lit("k").alias("k"), (4999 - F.col("id")).alias("n"), F.col("id").cast("string").alias("t"))
    assert joined_in_order(frame, ["k"], "n", "t", ",", block=64).first().t == ",".join(str(i) for i in range(4999, -1, -1))


def test_grades(spark, rows):
    queries = spark.createDataFrame([(q, m) for q, m in zip("abcdefg", ["ask"] * 5 + ["deep_dive"] * 2)], "query_id string, mode string")
    hits = spark.createDataFrame([("a", 0.6), ("a", 0.1), ("b", 0.35), ("c", 0.5), ("d", 0.5), ("f", 0.1), ("g", 0.2)], "query_id string, score double")
    judge = spark.createDataFrame([("c", " Yes. ok"), ("f", "yes"), ("b", "yes")], "query_id string, verdict string")
    assert rows(grade(queries, hits, judge), "query_id", "top_score", "sufficient", "needs_judge") == [
        ("a", 0.6, True, False), ("b", 0.35, False, False), ("c", 0.5, True, False), ("d", 0.5, False, True),
        ("e", 0.0, False, False), ("f", 0.1, True, False), ("g", 0.2, False, True)]


def test_requests(spark):
    frame = spark.createDataFrame([("ask", None, "x", "t"), ("deep_dive", None, "", " "), ("odd", "p", "x" * 8001, "t" * 121)],
                                  "mode string, paper_id string, content string, title string")
    assert [r.violations for r in check_requests(frame).collect()] == [
        [], ["deep_dive without paper_id", "message length", "blank title"], ["unknown mode", "message length", "title length"]]
