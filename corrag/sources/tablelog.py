"""A store of several tables that change together: runs are appended, commits make them visible.

A run writes its rows of every table, and the papers that it replaces, into folders of its own, and then one
commit file. Readers look at committed runs only, so a run that breaks off between two tables is never seen
and needs no repair: its folders are just never listed. Commits are numbered; a number can be taken once, so
two runs at the same time follow each other. A paper's rows are those of its latest committed run, even if
that run has none.

The cost of a run follows its own rows; nothing that is stored is read or written. Readers leave out rows of
replaced papers by an anti join with the superseded (paper, run) pairs, which only exist for papers that were
ingested more than once since the last ``compact``. That job writes what is visible as one run on which later
ones build; ``expire`` deletes the runs before it, once no reader uses them.

The commit file is created under a name that must not exist, which Hadoop file systems with atomic creation
guarantee. Null paper ids are not stored. All rows lie in folders by paper bucket; a search in some papers
reads no others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag.session import arrow_batches, open_files, shuffles_dropped
from corrag.sources.store import STORE_BUCKETS

#: Buckets that a task writes to without a sort; a split of rows that lie by bucket has few.
_OPEN_FILES = 16
#: Bytes of the Arrow batches of such a task: slices of words are whole, and no batch is much larger than they are.
_BATCH_BYTES = 1 << 24
#: Of the files: children repeat their parent's text, and most chunks share words.
_CODEC = "zstd"
_COMMITS, _REPLACED = "_commits", "replaced"
_PAPER = T.StructType([T.StructField("paper_id", T.StringType())])


@dataclass(frozen=True)
class Commit:
    version: int
    run: str
    tables: tuple[str, ...]
    base: bool  # nothing before it counts any more


class CommitConflict(RuntimeError):
    """Another run has committed since a compaction began; run it again."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def read_commits(spark: SparkSession, store: str) -> list[Commit]:
    """The commits that count, oldest first: the latest base and all after it. One small file each."""
    system, folder = _files(spark, f"{store}/{_COMMITS}")
    if not system.exists(folder):
        return []
    paths = [str(status.getPath()) for status in system.listStatus(folder) if str(status.getPath()).endswith(".json")]
    commits = []
    for path in paths:
        try:
            value = json.loads("".join(row.value for row in spark.read.text(path).collect()))
        except ValueError:  # the writer stopped before its content came; the number stays unused
            continue
        commits.append(Commit(value["version"], value["run"], tuple(value["tables"]), value["base"]))
    commits.sort(key=lambda commit: commit.version)
    last = max((i for i, commit in enumerate(commits) if commit.base), default=0)
    return commits[last:]


def _numbers(spark: SparkSession, store: str) -> list[int]:
    system, folder = _files(spark, f"{store}/{_COMMITS}")
    if not system.exists(folder):
        return []
    names = [str(status.getPath().getName()) for status in system.listStatus(folder)]
    return [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]


def _commit(spark: SparkSession, store: str, run: str, tables: list[str], base: bool, version: int | None = None) -> int:
    """Take the next number, or exactly ``version``; what is committed is visible from here on."""
    while True:
        number = max(_numbers(spark, store), default=0) + 1 if version is None else version
        system, path = _files(spark, f"{store}/{_COMMITS}/{number:012d}.json")
        try:
            out = system.create(path, False)
        except Py4JJavaError as taken:
            if not system.exists(path):
                raise
            if version is not None:
                raise CommitConflict(f"{store}: version {version} is taken") from taken
            continue
        out.write(bytearray(json.dumps({"version": number, "run": run, "tables": tables, "base": base}).encode()))
        out.close()
        return number


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.filter(F.col("paper_id").isNotNull()).withColumn("bucket", _bucket(buckets))


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    with shuffles_dropped(rows.sparkSession):
        _files_of(_placed(rows, buckets).hint("rebalance", "bucket"), path)


def _files_of(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("bucket").option("compression", _CODEC).parquet(path)


@dataclass
class Run:
    """The tables of one run, written one after the other; nothing is visible before ``commit``."""

    spark: SparkSession
    store: str
    buckets: int = STORE_BUCKETS
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: list[str] = field(default_factory=list)

    def write(self, name: str, rows: DataFrame) -> None:
        _write(rows, self._path(name), self.buckets)
        self.tables.append(name)

    def gather(self, rows: DataFrame) -> DataFrame:
        """The rows with those of a bucket next to each other, for a table that is made from them row by row."""
        return _placed(rows, self.buckets).hint("rebalance", "bucket").drop("bucket")

    def derive(self, name: str, rows: DataFrame) -> None:
        """A table that was made row by row from what ``gather`` or ``read`` gave. Its rows come bucket by bucket as
        they lie there, so they are written where they are, in about as many files, without another exchange."""
        with shuffles_dropped(self.spark), arrow_batches(self.spark, _BATCH_BYTES), open_files(self.spark, _OPEN_FILES):
            _files_of(_placed(rows, self.buckets), self._path(name))
        self.tables.append(name)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of a table of this run."""
        return _rows(self.spark, self.store, name, schema, [self.id], None, self.buckets).select(*schema.names)

    def commit(self, replaced: DataFrame, base: bool = False, version: int | None = None) -> int:
        """Make the run visible; returns the version. ``replaced`` lists all papers of the run: one without new
        rows still loses its old ones. Rows of other papers must not have been written."""
        _write(replaced.select(F.col("paper_id").cast("string").alias("paper_id")).distinct(), self._path(_REPLACED), self.buckets)
        return _commit(self.spark, self.store, self.id, sorted(self.tables), base, version)

    def _path(self, name: str) -> str:
        return f"{self.store}/{name}/run={self.id}"


def append_run(spark: SparkSession, store: str, tables: dict[str, DataFrame], replaced: DataFrame,
               buckets: int = STORE_BUCKETS, base: bool = False, version: int | None = None) -> int:
    """Write the rows of a run and commit them together, as ``Run.commit`` says; returns the version."""
    run = Run(spark, store, buckets)
    for name, rows in tables.items():
        run.write(name, rows)
    return run.commit(replaced, base, version)


def _rows(spark: SparkSession, store: str, name: str, schema: T.StructType, runs: list[str],
          papers: list[str] | None, buckets: int) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not runs:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("basePath", f"{store}/{name}").parquet(*(f"{store}/{name}/run={run}" for run in runs))
    if papers is not None:
        own = [F.pmod(F.xxhash64(F.lit(p)), F.lit(buckets)).cast("int") for p in papers]
        rows = rows.filter(F.col("bucket").isin(own) & F.col("paper_id").isin(papers))
    return rows


def read_table(spark: SparkSession, store: str, name: str, schema: T.StructType, papers: list[str] | None = None,
               buckets: int = STORE_BUCKETS, commits: list[Commit] | None = None) -> DataFrame:
    """The visible rows of a table; with ``papers`` only theirs, from no bucket but their own.

    Tables read with the same ``commits`` belong together, whatever is committed meanwhile.
    """
    commits = read_commits(spark, store) if commits is None else commits
    rows = _rows(spark, store, name, schema, [c.run for c in commits if name in c.tables], papers, buckets)
    if len(commits) > 1:
        listed = _rows(spark, store, _REPLACED, _PAPER, [c.run for c in commits], papers, buckets).select("paper_id", "run")
        version = F.create_map(*(F.lit(x) for c in commits for x in (c.run, c.version)))[F.col("run")]
        per_paper = listed.withColumn("_version", version).groupBy("paper_id").agg(
            F.max_by("run", "_version").alias("_latest"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
        superseded = listed.join(per_paper, "paper_id").filter(F.col("run") != F.col("_latest")).select("paper_id", "run")
        rows = rows.join(superseded, ["paper_id", "run"], "left_anti")
    return rows.select(*(f.name for f in schema.fields))


def compact(spark: SparkSession, store: str, schemas: dict[str, T.StructType], buckets: int = STORE_BUCKETS) -> int | None:
    """Write what is visible as one run that later reads begin with. Fails with ``CommitConflict`` if
    something else was committed meanwhile; the store is then as it was."""
    latest = max(_numbers(spark, store), default=0)  # read first: a later commit then takes this number plus one
    commits = read_commits(spark, store)
    if len(commits) < 2:
        return None
    visible = {name: read_table(spark, store, name, schema, buckets=buckets, commits=commits) for name, schema in schemas.items()}
    papers = _rows(spark, store, _REPLACED, _PAPER, [c.run for c in commits], None, buckets)
    return append_run(spark, store, visible, papers, buckets, True, latest + 1)


def expire(spark: SparkSession, store: str, names: list[str]) -> int:
    """Delete the folders of runs that are not visible, those that broke off included; returns their number.

    Only for times without readers of older versions and without running writers."""
    keep = {c.run for c in read_commits(spark, store)}
    gone = set()
    for name in (*names, _REPLACED):
        system, folder = _files(spark, f"{store}/{name}")
        if not system.exists(folder):
            continue
        for status in system.listStatus(folder):
            run = str(status.getPath().getName()).removeprefix("run=")
            if run not in keep:
                system.delete(status.getPath(), True)
                gone.add(run)
    return len(gone)
