"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams per language on the executors and gathers one bounded matrix of
log-probabilities (languages x buckets). ``predict`` sends that matrix to the tasks and scores
batches of texts in numpy.

Defined results: null text, or one without a letter -> ``und`` with score 0. No labelled row ->
every text is ``und``. Equal scores go to the first language by name. Very long texts are scored
in blocks, so memory stays bounded. Other columns stay; a column that has an output's name is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import slices, text_slices

#: Lengths of the n-grams, in code points.
SIZES = (1, 2, 3)
#: Buckets that all n-grams hash to.
BUCKETS = 1 << 15
#: Code points that one numpy block holds.
BLOCK = 1 << 19
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_probs: np.ndarray  # languages x BUCKETS


def _buckets(points: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point but the last two; ``BUCKETS`` at a zero,
    which closes a text."""
    n = len(points) - 2
    h = np.full(n, size * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(size):
        h += points[k:k + n] * np.uint32(_FACTORS[k])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return np.where(points[:n] == 0, np.uint32(BUCKETS), h >> np.uint32(32 - 15))


def _blocks(texts: list[str]):
    """(code points, first row, row starts): rows joined, each closed by two zeros.

    A text longer than a block comes in several blocks that overlap by two code points.
    """
    lowered = [t.lower() for t in texts]
    for a, b in slices([len(t) for t in lowered], BLOCK):
        if b - a == 1 and len(lowered[a]) > BLOCK:
            text = lowered[a] + "\0\0"
            for i in range(0, len(text) - 2, BLOCK):
                yield _points(text[i:i + BLOCK + 2]), a, np.zeros(1, np.int64)
            continue
        lengths = np.array([len(t) + 2 for t in lowered[a:b]])
        yield (_points("\0\0".join(lowered[a:b]) + "\0\0\0\0"), a, np.concatenate(([0], np.cumsum(lengths)[:-1])))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_ngrams(texts: list[str]) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for points, _, _ in _blocks(texts):
        for size in SIZES:
            counts += np.bincount(_buckets(points, size), minlength=BUCKETS + 1)[:BUCKETS]
    return counts


def _count_batches(batches):
    """One row per (language, bucket) that this task has seen."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b, some in text_slices(batch.column(0), 4 * BLOCK):
            by_language: dict[str, list[str]] = {}
            for text, lang in zip(some, batch.column(1).slice(a, b - a).to_pylist()):
                by_language.setdefault(lang, []).append(text)
            for lang, texts in by_language.items():
                counts[lang] = counts.get(lang, 0) + count_ngrams(texts)
    for lang, vector in counts.items():
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(vector[at], pa.int64())],
            names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """A model from all labelled rows with a text. What reaches the driver is languages x BUCKETS numbers."""
    counted = (
        labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        .select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(_count_batches, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = counted["lang"].to_pylist()
    languages = tuple(sorted(set(names)))
    counts = np.full((len(languages), BUCKETS), smoothing)
    row = {name: i for i, name in enumerate(languages)}
    counts[[row[x] for x in names], counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)) if len(languages) else counts)


def score_texts(texts: list[str], log_probs: np.ndarray) -> np.ndarray:
    """Log-likelihoods, texts x languages. ``log_probs`` is buckets x languages."""
    out = np.zeros((len(texts), log_probs.shape[1]))
    log_probs = np.vstack((log_probs, np.zeros(log_probs.shape[1])))
    for points, first, starts in _blocks(texts):
        for size in SIZES:
            at = _buckets(points, size)
            for k in range(log_probs.shape[1]):
                out[first:first + len(starts), k] += np.add.reduceat(log_probs[:, k][at], starts)
    return out


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and its posterior, 0 to 1."""
    if not model.languages:
        return df.withColumns({lang_out: F.lit("und"), score_out: F.lit(0.0)})
    names = np.array(model.languages, dtype=object)
    sent = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.log_probs.T))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def scored(texts: pa.Array) -> pa.Array:
        langs, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for a, _, some in text_slices(texts, 4 * BLOCK):
            have = [i for i, t in enumerate(some) if t]
            if not have:
                continue
            logs = score_texts([some[i] for i in have], sent.value)
            best, at = logs.argmax(axis=1), a + np.array(have)
            langs[at] = names[best]
            scores[at] = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], fields=list(kind))

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (
        df.withColumn("_scored", scored(F.col(text_col)))
        .withColumns({
            lang_out: F.when(letters, F.col("_scored.lang")).otherwise("und"),
            score_out: F.when(letters, F.col("_scored.score")).otherwise(0.0)})
        .drop("_scored"))


def held_out(doc_id):
    """Column: the fold that a model never learns from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def query_langid(spark, sf_dir):
    from corrag.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.drop("lang"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
