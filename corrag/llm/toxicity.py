"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) teach linear classifiers in numpy. With ``g`` the logit,
``l`` the logistic loss and ``prior`` the share of toxic texts, the risk is
``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])``: the second term is the risk on clean
texts, estimated without any clean example. Where it turns negative, which only overfitting can do, a
step goes up that term instead of down the risk.

Features are words and their beginnings: hashed prefixes of 3 to 8 letters and whole words of 2 to 8
letters, each counted once a text. ``fit`` takes a sample of both kinds of text (``POSITIVE_ROWS`` and
``UNLABELLED_ROWS`` expected rows at most, see there), keeps the ``FEATURES`` buckets that stand out most in P
against U and trains ``MEMBERS`` classifiers, each a task of its own on its own part of the sample.
Scoring reads every whole text with the weights of these buckets only.

Defined results: null and empty texts, and texts without letters, score like a text without any feature.
Without a confirmed text, or without a feature that stands out, every score is 0. Null ids teach nothing
as positives and are never held out. Repeated rows each count. Repeated labels of an id: one confirmation is enough.
Long texts are read in blocks cut between words. Other columns stay; one with an output's name is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import discard, mix, read_table, slices
from corrag.session import staged

#: Expected numbers of rows that teach, at most; all rows where there are fewer.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 12_000
#: Buckets of all features, and how many of them get a weight.
BUCKETS, FEATURES = 1 << 20, 2_048
#: Classifiers whose logits are averaged, and the share of the sample that each one sees.
MEMBERS, SHARE = 3, 0.8
#: Letters of the shortest and longest prefix.
SHORTEST, LONGEST = 3, 8
#: Code points that one numpy block holds.
BLOCK = 1 << 19
#: A text counts as toxic from this score on.
THRESHOLD = 0.3
_NO_LETTER = re.compile(r"[\W\d_]")


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray  # the buckets with a weight, ascending
    weights: np.ndarray
    bias: float


@cache
def _letters() -> np.ndarray:
    """Whether a code point below 65,536 is a letter or a mark on one; those above count as letters."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(1 << 16)])


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about a block, cut where there is no letter."""
    at = 0
    while len(text) - at > BLOCK:
        gap = _NO_LETTER.search(text, at + BLOCK)
        if gap is None:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


def _part_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature, with repetition."""
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
    before = np.concatenate(([False], letter[:-1]))
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    found, h = [], np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(1, LONGEST + 1):
        still = starts + k <= ends
        starts, ends, owner, h = starts[still], ends[still], owner[still], h[still]
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + points[starts + k - 1])
        if k >= SHORTEST:
            found.append((owner, h))
        if k >= 2:
            whole = starts + k == ends
            found.append((owner[whole], mix(h[whole] ^ np.uint64(0xA0761D6478BD642F))))
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([o for o, _ in found]), (np.concatenate([x for _, x in found]) >> shift).astype(np.int64)


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature), sorted: a feature is its bucket, or with ``wanted``, which gives the
    number of each bucket and -1 for the others, that number."""
    parts = [(i, part) for i, text in enumerate(texts) if text for part in _parts(text.lower())]
    rows, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in slices([len(p) for _, p in parts], BLOCK):
        owner, bucket = _part_features([p for _, p in parts[a:b]])
        if wanted is not None:
            bucket = wanted[bucket].astype(np.int64)
            owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
        text = np.array([i for i, _ in parts[a:b]], np.int64)[owner]
        both = np.unique(text * BUCKETS + bucket)
        rows.append(both // BUCKETS)
        kinds.append(both % BUCKETS)
    both = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(kinds))
    return both // BUCKETS, both % BUCKETS


def train(rows: np.ndarray, kinds: np.ndarray, positive: np.ndarray, n_features: int, prior: float,
          steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, that minimise the non-negative risk; ``rows, kinds`` are the set entries of
    the sample's binary matrix and ``positive`` marks its confirmed rows. Adam over the whole sample."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = w[-1] + np.bincount(rows, w[kinds], len(positive))
        up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        loss = np.logaddexp(0, g)  # of calling a text clean
        clean_risk = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        slope = np.where(positive, -prior * up / n_p, up / n_u)  # of the clean term
        slope = slope - np.where(positive, prior * (1 - up) / n_p, 0) if clean_risk >= 0 else -slope
        gradient = np.append(np.bincount(kinds, slope[rows], n_features), slope.sum())
        gradient[:-1] += decay * w[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        w -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-9)
    return w


def _describe(batches):
    """Sampled rows to (positive, unlabelled, place, packed buckets)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices([len(t or "") for t in texts], BLOCK):
            rows, kinds = features(texts[a:b])
            ends = np.searchsorted(rows, np.arange(b - a), "right")
            packed = [x.tobytes() for x in np.split(kinds.astype(np.uint32), ends)[:b - a]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name).slice(a, b - a) for name in ("in_p", "in_u", "place")), pa.array(packed, pa.binary())],
                names=["in_p", "in_u", "place", "packed"])


def _frequencies(batches):
    """One row per bucket that this task has seen: rows of P and of U that have it."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for k, name in enumerate(("in_p", "in_u")):
            held = batch.filter(batch.column(name)).column("packed").to_pylist()
            counts[k] += np.bincount(np.frombuffer(b"".join(held), np.uint32), minlength=BUCKETS)
    at = np.flatnonzero(counts[0])  # what no confirmed text has cannot stand out
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "n_p", "n_u"])


def _numbers(buckets: np.ndarray) -> np.ndarray:
    """The number of each bucket with a weight, -1 for all others."""
    wanted = np.full(BUCKETS, -1, np.int16)
    wanted[buckets] = np.arange(len(buckets))
    return wanted


def _member(buckets: np.ndarray, prior: float):
    """Trains one classifier on its rows, which are no more than the sample."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        wanted, rows, kinds, positive = _numbers(buckets), [], [], []
        for packed, in_p, in_u in zip(*(table[name].to_pylist() for name in ("packed", "in_p", "in_u"))):
            mine = wanted[np.frombuffer(packed, np.uint32)]
            mine = mine[mine >= 0]
            for kind in [True] * in_p + [False] * in_u:
                rows.append(np.full(len(mine), len(positive)))
                kinds.append(mine.astype(np.int64))
                positive.append(kind)
        weights = train(np.concatenate(rows), np.concatenate(kinds), np.array(positive), len(buckets), prior)
        return pa.table({"member": [key[0].as_py()], "weights": [weights.tolist()]},
                        schema=pa.schema([("member", pa.int32()), ("weights", pa.list_(pa.float64()))]))

    return run


def fit(docs: DataFrame, confirmed: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """A model from texts and the ids of confirmed toxic ones; None where nothing can be learned.

    ``docs`` holds the rows that may teach; each of them is unlabelled text, the confirmed ones are
    positive as well. What reaches the driver is the chosen buckets and the weights."""
    ids = confirmed.select(F.col(id_col).alias("_id")).dropna().distinct()
    n_ids = ids.count()
    chosen = F.broadcast(ids.sample(min(1.0, POSITIVE_ROWS / max(1, n_ids)), 11))  # expected rows are bounded
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
            .join(chosen.withColumn("_yes", F.lit(True)), "_id", "left").withColumn("_yes", F.coalesce("_yes", F.lit(False))))
    n_u, n_p = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("_yes").cast("long")), F.lit(0))).first()
    if not n_p:
        return None
    sample = staged(
        rows.withColumns({"in_p": F.col("_yes") & (F.rand(12) < min(1.0, POSITIVE_ROWS / n_p)),
                          "in_u": F.rand(13) < min(1.0, UNLABELLED_ROWS / n_u), "place": F.rand(14)})
        .filter("in_p OR in_u").select("in_p", "in_u", "place", "text")
        .mapInArrow(_describe, "in_p boolean, in_u boolean, place double, packed binary"), "sample")
    total = sample.agg(F.sum(F.col("in_p").cast("long")), F.sum(F.col("in_u").cast("long"))).first()
    share_p, share_u = F.col("n_p") / max(1, total[0]), (F.col("n_u") + 1) / (total[1] + 1)
    counted = sample.mapInArrow(_frequencies, "bucket long, n_p long, n_u long").groupBy("bucket").agg(
        F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u"))
    best = (counted.filter((F.col("n_p") >= 2) & (share_p >= 2 * share_u))
            .orderBy((share_p * F.log(share_p / share_u)).desc(), "bucket").limit(FEATURES).select("bucket"))
    buckets = np.sort(np.array([r.bucket for r in best.collect()], np.int64))
    if not len(buckets):
        return None
    members = sample.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
    seen = members.filter(F.pmod(F.xxhash64("place", "member"), F.lit(1000)) < int(1000 * SHARE))
    trained = seen.groupBy("member").applyInArrow(_member(buckets, prior), "member int, weights array<double>").collect()
    discard(sample)
    weights = np.mean([r.weights for r in trained], axis=0)
    return ToxicityModel(buckets, weights[:-1], float(weights[-1]))


def score_texts(texts: list[str | None], wanted: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    rows, kinds = features(texts, wanted)
    return 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights[kinds], len(texts)), -40, 40)))


def predict(df: DataFrame, model: ToxicityModel | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``df`` with the probability that a text is toxic."""
    if model is None:
        return df.withColumn(score_out, F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast((_numbers(model.buckets), model.weights, model.bias))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        return pa.array(np.concatenate([np.empty(0)] + [
            score_texts(texts[a:b], *sent.value) for a, b in slices([len(t or "") for t in texts], BLOCK)]))

    return df.withColumn(score_out, scored(F.col(text_col)))


def held_out(doc_id):
    """Column: the fold whose labels a model never learns from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def share_of_ones(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> float:
    """The class prior: the share of confirmed rows among the labelled ones, between 0.1 % and 50 %."""
    share = labels.filter(F.col(id_col).isNotNull()).agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0]
    return min(0.5, max(0.001, share or 0.0))


def query_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    teaching = docs.filter(~held_out(F.col("doc_id")))
    model = fit(teaching, labels.filter("toxic = 1"), share_of_ones(labels))
    return (predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
