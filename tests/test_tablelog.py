"""The log of runs: what is visible after whole, broken, repeated and concurrent runs."""

import os

import pytest

from corrag import schemas
from corrag.sources import tablelog

KIND = "paper_id string, value string"
SCHEMA = schemas._struct(paper_id=schemas.STRING, value=schemas.STRING)


@pytest.fixture
def store(spark, tmp_path):
    """``run(a, b, papers)`` appends to both tables; ``seen(table, **options)`` gives its visible rows."""
    path = str(tmp_path / "store")

    def frame(rows):
        return spark.createDataFrame(rows, KIND)

    def run(a, b, papers, **options):
        listed = spark.createDataFrame([(p,) for p in papers], "paper_id string")
        return tablelog.append_run(spark, path, {"a": frame(a), "b": frame(b)}, listed, 4, **options)

    def seen(table, **options):
        return sorted((tuple(r) for r in tablelog.read_table(spark, path, table, SCHEMA, buckets=4, **options).collect()), key=repr)

    return path, run, seen


def test_latest_run_of_a_paper_counts(store):
    path, run, seen = store
    assert seen("a") == []
    assert run([("p", "1"), ("q", "1")], [("p", "x")], ["p", "q"]) == 1
    assert run([("p", "2"), ("p", "2")], [], ["p", "p", "r", None]) == 2
    assert seen("a") == [("p", "2"), ("p", "2"), ("q", "1")] and seen("b") == []
    run([], [("q", "y")], ["q"])
    assert seen("a") == [("p", "2"), ("p", "2")] and seen("b") == [("q", "y")]
    assert seen("a", papers=["q"]) == [] and seen("a", papers=["p", "none"]) == [("p", "2"), ("p", "2")]


def test_null_papers_are_not_stored(store):
    _, run, seen = store
    run([(None, "1"), ("p", "1")], [], [None, "p"])
    assert seen("a") == [("p", "1")]


@pytest.mark.parametrize("broken", ["b", "replaced", "commit"])
def test_a_broken_run_is_invisible(spark, store, monkeypatch, broken):
    path, run, seen = store
    run([("p", "1")], [("p", "x")], ["p"])
    write, commit = tablelog._write, tablelog._commit

    def stop(rows, target, buckets):
        if f"/{broken}/" in target:
            raise OSError("lost")
        write(rows, target, buckets)

    def no_commit(*args):
        if broken == "commit":
            raise OSError("lost")
        return commit(*args)

    monkeypatch.setattr(tablelog, "_write", stop)
    monkeypatch.setattr(tablelog, "_commit", no_commit)
    with pytest.raises(OSError):
        run([("p", "2"), ("q", "2")], [("p", "y")], ["p", "q"])
    monkeypatch.undo()
    assert seen("a") == [("p", "1")] and seen("b") == [("p", "x")]
    assert tablelog.expire(spark, path, ["a", "b"]) == 1 and seen("a") == [("p", "1")]
    run([("p", "3")], [], ["p"])
    assert seen("a") == [("p", "3")] and seen("b") == []


def test_a_commit_without_content_is_skipped(spark, store):
    path, run, seen = store
    run([("p", "1")], [], ["p"])
    open(os.path.join(path, "_commits", f"{2:012d}.json"), "w").close()
    assert seen("a") == [("p", "1")] and run([("p", "2")], [], ["p"]) == 3 and seen("a") == [("p", "2")]


def test_readers_keep_their_version(spark, store):
    path, run, seen = store
    run([("p", "1")], [("p", "x")], ["p"])
    commits = tablelog.read_commits(spark, path)
    run([("p", "2")], [], ["p"])
    assert seen("a", commits=commits) == [("p", "1")] and seen("b", commits=commits) == [("p", "x")]


def test_compaction(spark, store, monkeypatch):
    path, run, seen = store
    both = {"a": SCHEMA, "b": SCHEMA}
    assert tablelog.compact(spark, path, both, 4) is None
    run([("p", "1"), ("q", "1")], [], ["p", "q"])
    run([("p", "2")], [("r", "z")], ["p", "r"])
    before = seen("a"), seen("b")
    assert tablelog.compact(spark, path, both, 4) == 3 and (seen("a"), seen("b")) == before
    assert len(tablelog.read_commits(spark, path)) == 1 and tablelog.expire(spark, path, ["a", "b"]) == 2
    assert (seen("a"), seen("b")) == before
    run([], [], ["q"])
    assert seen("a") == [("p", "2")]
    write, calls = tablelog._write, []

    def meanwhile(rows, target, buckets):
        write(rows, target, buckets)
        if not calls:
            calls.append(1)
            run([("s", "9")], [], ["s"])

    monkeypatch.setattr(tablelog, "_write", meanwhile)
    with pytest.raises(tablelog.CommitConflict):
        tablelog.compact(spark, path, both, 4)
    monkeypatch.undo()
    assert seen("a") == [("p", "2"), ("s", "9")]
