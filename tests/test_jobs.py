"""Store, ingestion, corrective loop, streaming jobs, and the registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corrag import schemas
from corrag.operators.blocks import documents_to_blocks
from corrag.plans.answer import prepare_queries, summarize
from corrag.plans.corpus import Settings, build_corpus
from corrag.plans.correct import build_reserve, corrective_search, search_reserve
from corrag.plans.evaluate import check_baseline
from corrag.plans.ingest import ingest_to_store
from corrag.session import new_shared_path
from corrag.sources.store import read_store, upsert_paper_chunks, upsert_store, write_store
from corrag.sources.tablelog import read_table
from corrag.streaming.common import append_to, stream_parquet, stream_table
from corrag.streaming.ingest import stream_ingest
from corrag.streaming.limits import stream_rate_limits
from corrag.streaming.turns import stream_turns


def test_upsert(spark, rows):
    old = spark.createDataFrame([("p", "p0"), ("p", "p1"), ("q", "q0"), ("r", "r0")], "paper_id string, chunk_id string")
    new = spark.createDataFrame([("p", "p9"), ("q", "q9")], "paper_id string, chunk_id string")
    run = spark.createDataFrame([("p",), ("q",), ("s",)], "paper_id string")
    status = spark.createDataFrame([("p", "abstract_only"), ("q", "full")], "paper_id string, ingestion_status string")
    once = upsert_paper_chunks(old, new, run, status)
    assert rows(once, "chunk_id") == [("p9",), ("q0",), ("r0",)]
    assert rows(upsert_paper_chunks(once, new, run, status), "chunk_id") == rows(once, "chunk_id")
    assert rows(upsert_paper_chunks(old, new, run, status, force=True), "chunk_id") == [("p9",), ("q9",), ("r0",)]
    assert rows(upsert_paper_chunks(old, new.limit(0), run, status), "chunk_id") == [("q0",), ("r0",)]


def chunk_rows(spark, pairs):
    return spark.createDataFrame(
        [(c, p, "child", "text", None, "S", c, None, 1) for p, c in pairs], schemas.CHUNKS)


def test_store_replaces_even_the_last_rows_of_a_bucket(spark, rows):
    path = new_shared_path(spark, "store-test")
    write_store(chunk_rows(spark, [("p", "p0"), ("q", "q0")]), path, 4)
    run = spark.createDataFrame([("p",)], "paper_id string")
    upsert_store(spark, path, chunk_rows(spark, []), run, schemas.CHUNKS, 4)
    assert rows(read_store(spark, path, schemas.CHUNKS), "chunk_id") == [("q0",)]
    for _ in range(2):
        upsert_store(spark, path, chunk_rows(spark, [("p", "p1"), ("q", "ignored")]), run, schemas.CHUNKS, 4)
    assert rows(read_store(spark, path, schemas.CHUNKS), "chunk_id") == [("p1",), ("q0",)]


PAGE = "<section><h2>{}</h2><p>{}</p></section><section><h2>References</h2><p>x</p></section>"


def test_ingest_to_store(spark, rows):
    path = new_shared_path(spark, "ingest-test")
    papers = spark.createDataFrame([("a", "abs"), ("b", ""), ("c", "")], "paper_id string, abstract string")
    pages = spark.createDataFrame([("a", PAGE.format("One", "alpha beta")), ("b", None), ("c", "<p>none</p>")], schemas.PAGES)
    lines = spark.createDataFrame([("b", 0, 0, "Head", 14.0, False, 0.0, 5.0, False), ("b", 0, 1, "body", 9.0, False, 9.0, 12.0, False)], schemas.LINES)
    for _ in range(2):
        ingest_to_store(spark, path, papers, pages, lines, Settings(dim=8), buckets=2)
    chunks = read_table(spark, path, "chunks", schemas.CHUNKS)
    assert rows(chunks.filter("chunk_type = 'child'"), "paper_id", "section_name", "text") == [("a", "One", "alpha beta"), ("b", "Head", "body")]
    assert rows(read_table(spark, path, "vectors", schemas.VECTORS), "chunk_id") == [("a#0#0",), ("b#0#0",)]
    assert chunks.filter("chunk_type = 'parent'").count() == 5


def test_full_papers_are_not_ingested_again(spark, rows):
    path = new_shared_path(spark, "ingest-skip")
    papers = spark.createDataFrame([("a", ""), ("b", "")], "paper_id string, abstract string")
    known = spark.createDataFrame([("a", "full"), ("b", "failed")], "paper_id string, ingestion_status string")
    pages = lambda text: spark.createDataFrame([(p, PAGE.format("S", text)) for p in "ab"], schemas.PAGES)
    texts = lambda: rows(read_table(spark, path, "chunks", schemas.CHUNKS).filter("chunk_type = 'child'"), "paper_id", "text")
    ingest_to_store(spark, path, papers, pages("one"), settings=Settings(dim=4), buckets=2)
    ingest_to_store(spark, path, papers, pages("two"), settings=Settings(dim=4), buckets=2, existing_papers=known)
    assert texts() == [("a", "one"), ("b", "two")]
    ingest_to_store(spark, path, papers, pages("three"), settings=Settings(dim=4), buckets=2, existing_papers=known, force=True)
    assert texts() == [("a", "three"), ("b", "three")]


def test_first_run_saves_the_baseline(spark, rows):
    path = new_shared_path(spark, "baselines")
    scores = lambda *x: spark.createDataFrame([(*i,) for i in x], schemas.SCORES)
    assert check_baseline(spark, scores(("p", "m", 0.9)), path).count() == 0
    later = check_baseline(spark, scores(("p", "m", 0.8), ("q", "m", 0.1)), path)
    assert rows(later) == [("p", "m", 0.8, 0.9)]
    assert rows(check_baseline(spark, scores(("q", "m", 0.0), ("p", "m", 0.86)), path), "paper_id") == [("q",)]


def papers_of(spark, items):
    docs = spark.createDataFrame(items, "paper_id string, text string, published_date string")
    papers = docs.select("paper_id", F.concat(F.lit("On "), "text").alias("title"), F.lit("").alias("abstract"),
                         "published_date", F.lit("full").alias("ingestion_status"))
    return papers, documents_to_blocks(docs)


def test_corrective_loop(spark, rows):
    corpus = build_corpus(*papers_of(spark, [("in1", "red green blue", "2020")]), Settings(dim=16))
    reserve = build_reserve(*papers_of(spark, [
        ("out1", "quantum walks on graphs", "2019"), ("out2", "quantum noise", "2024"), ("out3", "cooking rice", "2022")]))
    asked = spark.createDataFrame([
        ("ok", "red green blue", "ask", None), ("short", "quantum walks on graphs", "ask", None),
        ("deep", "quantum walks", "deep_dive", "in1"), ("hi", "hello", "ask", None)],
        "query_id string, user_message string, mode string, paper_id string")
    queries = prepare_queries(asked, corpus)
    done = corrective_search(queries, corpus, reserve)
    got = {r.query_id: (r.sufficient, r.route, r.cited_papers) for r in summarize(done.evidence).collect()}
    assert got["ok"] == (True, "generate_ask", "in1") and got["deep"][1] == "deep_dive_insufficient"
    assert got["short"][:2] == (True, "generate_ask") and got["short"][2].startswith("out1") and "hi" not in got
    assert rows(done.rounds, "query_id", "paper_id", "attempt") == [("short", "out1", 1)]
    assert rows(done.corpus.papers, "paper_id") == [("in1",), ("out1",)]
    assert done.corpus.vectors.count() == 2
    one = corrective_search(queries, corpus, reserve, max_retries=1)
    assert {r.query_id: r.sufficient for r in summarize(one.evidence).collect()}["short"] is False
    assert one.corpus.papers.count() == 2


def test_reserve_search_orders_by_date_on_request(spark):
    reserve = build_reserve(*papers_of(spark, [
        ("o1", "quantum quantum quantum", "2019"), ("o2", "quantum noise in a long title of many words", "2024"), ("o3", "rice", "2025")]))
    asked = spark.createDataFrame([("a", "quantum"), ("b", "latest quantum")], "query_id string, user_message string")
    got = search_reserve(asked, reserve).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.paper_id) for r in got] == [("a", "o1"), ("a", "o2"), ("b", "o2"), ("b", "o1")]
    wrote = spark.createDataFrame([("a", 0, "rice"), ("a", 1, "noise")], "query_id string, list_no int, text string")
    got = search_reserve(asked, reserve, wrote).orderBy("list_no", "rank").collect()
    assert [(r.query_id, r.list_no, r.paper_id) for r in got] == [("a", 0, "o3"), ("a", 1, "o2")]


def run_stream(spark, frame, build, name):
    """The rows as files, streamed in order, one file per micro-batch."""
    source, out = new_shared_path(spark, f"{name}-in"), new_shared_path(spark, f"{name}-out")
    for number, rows_ in enumerate(frame):
        rows_.coalesce(1).write.mode("append").parquet(f"{source}/{number}")
    stream = spark.readStream.schema(frame[0].schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(source)
    result = build(stream)
    append_to(result, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


T0 = dt.datetime(2024, 1, 1)


def test_stream_turns(spark, rows):
    kind = "session_id string, turn_id long, seq long, ts timestamp, type string, content string, arxiv_id string, title string, abstract_snippet string"

    def event(turn, seq, second, type_, content=None):
        return ("s", turn, seq, T0 + dt.timedelta(seconds=second), type_, content, "id" if type_ == "citation" else None, None, None)

    first = [event(1, 2, 2, "token", "b"), event(1, 1, 1, "token", "a"), event(1, 3, 3, "citation"), event(1, 4, 4, "done"),
             event(2, 1, 10, "token", "no end"), event(3, 1, 20, "error", "rate_limited")]
    later, last = [event(9, 1, 7200, "token", "x")], [event(9, 2, 7201, "token", "y")]
    late = [event(1, 0, 0, "token", "late"), event(9, 3, 7202, "done", "open")]
    # A batch drops events by the watermark that the batch before it started with.
    out = run_stream(spark, [spark.createDataFrame(x, kind) for x in (first, later, last, late)], stream_turns, "turns")
    assert [(r.turn_id, r.content[:1], r.cited) for r in out.orderBy("turn_id").collect()] == [(1, "a", ["id"]), (3, "⚠", [])]


def test_stream_rate_limits(spark, rows):
    kind = "client_id string, route string, ts timestamp"
    first = [("c", "papers POST", T0 + dt.timedelta(seconds=i)) for i in range(11)] + [("d", "papers POST", T0)]
    later = [("c", "papers POST", T0 + dt.timedelta(hours=1))]
    out = run_stream(spark, [spark.createDataFrame(x, kind) for x in (first, later)], stream_rate_limits, "limits")
    assert rows(out, "client_id", "n", "over_limit") == [("c", 11, True), ("d", 1, False)]


def test_stream_ingest_replaces(spark, rows):
    source, store = new_shared_path(spark, "pages-in"), new_shared_path(spark, "pages-store")
    batches = [[("a", PAGE.format("One", "first"))], [("a", PAGE.format("One", "second")), ("b", PAGE.format("B", "bb"))]]
    for batch in batches:
        spark.createDataFrame(batch, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)
        stream_ingest(stream_table(spark, source, "*.parquet", schemas.PAGES), store, f"{store}-checkpoint",
                      Settings(dim=4), buckets=2, available_now=True).awaitTermination()
    chunks = read_table(spark, store, "chunks", schemas.CHUNKS)
    assert rows(chunks.filter("chunk_type = 'child'"), "paper_id", "text") == [("a", "second"), ("b", "bb")]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, rows, tmp_path, files):
    from __spark_entry__ import queries

    pages = spark.createDataFrame([(i, f"u{i}", f"<article><h1>T</h1>word {i}</article>") for i in range(6)],
                                  "page_id long, url string, html string").repartition(files)
    pages.write.parquet(str(tmp_path / "pages.parquet" if files > 1 else tmp_path / "parts"))
    if files == 1:
        next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    streamed = stream_parquet(spark, str(tmp_path / "pages.parquet"), pages.schema)
    out = run_on(spark, streamed.select("page_id"))
    assert rows(out, "page_id") == [(i,) for i in range(6)]
    columns = "paper_id", "chunk_type", "n_chunks", "tokens"
    assert rows(queries()["stream_ingest"](spark, str(tmp_path)), *columns) == sorted(
        [(str(i), "child", 1, 2) for i in range(6)] + [(str(i), "parent", 2, 2) for i in range(6)], key=repr)


def run_on(spark, stream):
    path = new_shared_path(spark, "streamed")
    append_to(stream, path, f"{path}-checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


SMOKE = ["bm25_topk", "dense_topk", "filter_blocks", "line_blocks", "page_blocks", "paper_upsert", "intent",
         "context_budget", "history_trim", "attribution", "grading_metrics", "sessions_list", "rate_windows"]


@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_its_sql(spark, name):
    from oracle_check import compare, duck

    sf_dir = "/root/testdata/sf0.001"
    good, note = compare(spark, duck(sf_dir), name, sf_dir)
    assert good, note


def test_every_query_has_sql_or_a_reason():
    from corrag import catalog

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"ann_recall", "corrective"}


def test_a_store_knows_status_and_opens_by_paper(spark, tmp_path):
    from corrag.plans.corpus import open_corpus
    from corrag.plans.ingest import ingest_to_store

    papers = spark.createDataFrame([(p, p.upper(), "") for p in "abc"], "paper_id string, title string, abstract string")
    pages = spark.createDataFrame([("a", "<section><h2>T</h2><p>one two</p></section>"), ("b", "no section")], "paper_id string, html string")
    failed = spark.createDataFrame([("c",)], "paper_id string")
    ingest_to_store(spark, str(tmp_path), papers, pages, buckets=4, failed=failed)
    corpus = open_corpus(spark, str(tmp_path), buckets=4)
    assert {(r.paper_id, r.title, r.ingestion_status) for r in corpus.papers.collect()} == {
        ("a", "A", "full"), ("b", "B", "abstract_only"), ("c", "C", "failed")}
    one = open_corpus(spark, str(tmp_path), papers=["a"], buckets=4)
    assert one.children.count() == one.vectors.count() == one.counts.count() == 1
    assert "bucket IN" in one.chunks._jdf.queryExecution().toString() or "(bucket" in one.chunks._jdf.queryExecution().toString()
    ingest_to_store(spark, str(tmp_path), papers, pages, buckets=4, existing_papers=corpus.papers)
    assert open_corpus(spark, str(tmp_path), buckets=4).papers.count() == 3


def test_a_page_that_cannot_be_read_fails_its_paper(spark, rows):
    from corrag.operators.blocks import extract_blocks, read_pages, unreadable
    from corrag.plans.ingest import ingest_pages

    good, bad = "<section><h2>T</h2><p>one two</p></section>", "<section><h2>T</h2><p>x</p></section><![bad[markup]]>"
    pages = spark.createDataFrame([("a", good), ("b", bad), ("c", bad), ("d", None)], "paper_id string, html string")
    papers = spark.createDataFrame([(p, p, "") for p in "abcde"], "paper_id string, title string, abstract string")
    read = read_pages(pages)
    assert [r.paper_id for r in extract_blocks(pages).collect()] == ["a"]
    assert {(r.paper_id, r.error.split(":")[0]) for r in unreadable(read).collect()} == {("b", "AssertionError"), ("c", "AssertionError")}
    lines = spark.createDataFrame([("c", 1, i, t, 10.0, False, float(i), i + 1.0, False) for i, t in enumerate(["some", "lines"])],
                                  schemas.LINES)
    failed = spark.createDataFrame([("e",)], "paper_id string")
    status = ingest_pages(papers, pages, lines, Settings(dim=4), failed=failed)[0]
    assert rows(status, "paper_id", "ingestion_status") == [
        ("a", "full"), ("b", "failed"), ("c", "full"), ("d", "abstract_only"), ("e", "failed")]


def test_a_run_writes_every_table_once_and_leaves_no_shuffle_files(spark, rows, tmp_path, monkeypatch):
    """Texts go into the store and nowhere else; blocks of other papers, and without a paper, stay out."""
    import os
    import time

    from corrag.plans.ingest import ingest_blocks_to_store

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        listed = disk.getAllFiles().iterator()
        found = set()
        while listed.hasNext():
            name = listed.next().getName()
            found |= {name} if name.startswith("shuffle_") else set()
        return found

    text = " ".join(f"w{i}" for i in range(300))
    papers = spark.createDataFrame([(p, "T", "") for p in ("a", "b", "b", None)], "paper_id string, title string, abstract string")
    blocks = spark.createDataFrame([(p, 0, "S", text, "text", None) for p in ("a", "b", "x", None)], schemas.BLOCKS)
    before = shuffled()
    monkeypatch.setattr("corrag.session.shared_folder", lambda spark: str(tmp_path / "shared"))
    ingest_blocks_to_store(spark, str(tmp_path / "store"), papers, blocks, Settings(128, 16, 8), buckets=4)
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "shared") for f in names if f.endswith(".parquet")]
    assert all("text" not in spark.read.parquet(f).columns and "terms" not in spark.read.parquet(f).columns for f in files)
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    chunks = read_table(spark, str(tmp_path / "store"), "chunks", schemas.CHUNKS)
    windows = ("#0", "#0#0", "#0#1", "#0#2")
    assert rows(chunks.filter("section_name = 'S'"), "chunk_id") == sorted(((p + w,) for p in "ab" for w in windows), key=repr)
    vectors, terms = (read_table(spark, str(tmp_path / "store"), name, schema) for name, schema in (("vectors", schemas.VECTORS), ("terms", schemas.TERM_COUNTS)))
    assert rows(vectors, "chunk_id", "section_name", "chunk_type", "content_type") == sorted(((p + w, "S", "child", "text") for p in "ab" for w in windows[1:]), key=repr)
    assert rows(terms, "chunk_id", "length") == sorted(((p + w, n) for p in "ab" for w, n in zip(windows[1:], (128, 128, 76))), key=repr)


def test_a_plugged_in_embedder_fills_the_vectors_of_a_run(spark, rows, tmp_path):
    from corrag.plans.ingest import ingest_blocks_to_store

    papers = spark.createDataFrame([("a", "T", "")], "paper_id string, title string, abstract string")
    blocks = spark.createDataFrame([("a", 0, "S", "one two", "text", None)], schemas.BLOCKS)
    ingest_blocks_to_store(spark, str(tmp_path), papers, blocks, Settings(embedder=lambda texts: [[float(len(t))] for t in texts]), buckets=4)
    assert rows(read_table(spark, str(tmp_path), "vectors", schemas.VECTORS), "chunk_id", "dense_vector") == [("a#0#0", [7.0])]
