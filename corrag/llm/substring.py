"""Substring dedup: words covered by a window that occurs elsewhere go, by FM-indexes over shards.

A window is ``WINDOW`` consecutive words of one document; it is repeated when its word sequence
starts at two places or more of the whole table.

1. Every window names an anchor: its smallest ``GRAM``-word hash, the leftmost at a tie. The anchor
   depends on the window's words alone, so equal windows have equal anchors. Neighbouring windows
   with one anchor form a piece; a text of n words has about n / 14 pieces.
2. Anchors that occur once are dropped. Equal pieces become one, with the number of their places as
   weight. Pieces are combined per block of documents before they are shuffled.
3. Pieces are dealt to shards by their anchor, and their words are cut from the texts. A shard builds
   a compressed FM-index (wavelet matrix) over its pieces and streams them against it: backward search
   gives matching statistics, and windows whose weight is 2 or more are reported.
   An anchor with more than ``HOT`` different pieces is not kept in one shard: its windows go apart,
   dealt by their place relative to the anchor and by their outer words, which equal windows share.
4. The reports go back to the documents, which lose the covered words.

Defined results: null text has no words; texts shorter than a window lose nothing. Equal texts of a
window's length or more lose every word, and repeated rows count as copies. Rows are named by a number of
their own, so ids may be null or repeat; every row comes out once. Empty tables give no rows. Texts are read whole. Extra columns are not
touched by ``remove_repeats`` and left out by ``repeat_digest``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import discard, mix, numbered, read_table, text_slices
from corrag.llm.fmindex import FMIndex, repeated_windows
from corrag.llm.shingles import BLOCK, _power_tables, shingle_hashes, text_words
from corrag.session import TEXT_BATCH, staged

WINDOW = 35
#: Words of an anchor.
GRAM = 8
#: Words that the pieces of one shard hold, on average.
SHARD_WORDS = 1 << 19
#: Different pieces of an anchor above which its windows are dealt one by one.
HOT = 4096
#: Pieces that meet in one bucket, on average.
BUCKET_ROWS = 1 << 17
_PIECE = np.dtype([("anchor", "<i8"), ("piece", "<i8"), ("weight", "<i8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])


def find_pieces(words: np.ndarray, counts: np.ndarray):
    """(document, first window, windows, anchor hash, piece hash) of all pieces of some texts' words.

    ``words`` holds the word hashes of all texts, ``counts`` how many each has.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    offset = np.cumsum(counts) - counts
    last = len(words) - WINDOW + 1
    if last <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = shingle_hashes(words, GRAM)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)[:last]
    start = np.flatnonzero(doc[:last] == doc[WINDOW - 1:])
    anchor = start + view[start].argmin(axis=1)
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else start
    n = np.diff(np.append(fresh, len(start)))
    first = start[fresh]
    up, down = _power_tables(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)], dtype=np.uint64)))
    end = first + n + WINDOW - 1
    piece = mix((sums[end] - sums[first]) * down[first] + n.astype(np.uint64))
    of = doc[first]
    return of, first - offset[of], n, grams[anchor[fresh]], piece


def _as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


_DESCRIBED = "id long, name long, n_words long, sha256 string, pieces array<struct<anchor:long,piece:long,at:int,n:int>>"


def _describe(batches):
    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in text_slices(batch.column(1), BLOCK):
            texts = list(map(_as_bytes, texts))
            _, _, _, words, counts = text_words(texts)
            of, at, n, anchor, piece = find_pieces(words, counts)
            ends = np.searchsorted(of, np.arange(b - a + 1))
            rows = pa.StructArray.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(at, pa.int32()), pa.array(n, pa.int32())],
                names=["anchor", "piece", "at", "n"])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts, pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)],
                names=["id", "name", "n_words", "sha256", "pieces"])


def _combined(rows: np.ndarray) -> np.ndarray:
    """Equal pieces as one row with their weights added up, sorted by anchor and piece."""
    rows = rows[np.lexsort((rows["piece"], rows["anchor"]))]
    fresh = np.flatnonzero(np.concatenate(([True], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["piece"][1:] != rows["piece"][:-1]))))
    out = rows[fresh].copy()
    out["weight"] = np.add.reduceat(rows["weight"], fresh)
    return out


def _packed(buckets: int):
    def flush(held):
        rows = _combined(np.concatenate(held))
        bucket = (rows["anchor"].view(np.uint64) >> np.uint64(33)).astype(np.int64) * buckets >> 31
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        filled = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int32()), pa.array([rows[cuts[i]:cuts[i + 1]].tobytes() for i in filled], pa.binary())],
            names=["bucket", "packed"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            rows = np.empty(len(flat), _PIECE)
            for name in ("anchor", "piece", "at", "n"):
                rows[name] = flat.field(name).to_numpy(zero_copy_only=False)
            rows["weight"] = 1
            rows["doc"] = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            held.append(rows)
            total += len(rows)
            if total > 400_000:
                yield from flush(held)
                held, total = [], 0
        if total:
            yield from flush(held)

    return run


_REPEATED = "anchor long, piece long, weight long, doc long, at int, n int, hot boolean"


def _repeated(batches):
    """The pieces of anchors that occur twice or more; one bucket is held at a time."""
    def found(held):
        rows = _combined(np.frombuffer(b"".join(held), _PIECE))
        fresh = np.flatnonzero(np.concatenate(([True], rows["anchor"][1:] != rows["anchor"][:-1])))
        pieces = np.diff(np.append(fresh, len(rows)))
        keep = np.repeat(np.add.reduceat(rows["weight"], fresh) > 1, pieces)
        hot = np.repeat(pieces > HOT, pieces)[keep]
        rows = rows[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(rows[name])) for name in ("anchor", "piece", "weight", "doc", "at", "n")] + [pa.array(hot)],
            names=["anchor", "piece", "weight", "doc", "at", "n", "hot"])

    now, held = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                if held:
                    yield found(held)
                now, held = bucket, []
            held.append(packed)
    if held:
        yield found(held)


_CUT = "shard int, anchor long, piece long, weight long, first int, words binary"


def _cut(shards: int):
    """(text, pieces of it) to the pieces' words; windows of hot anchors come one by one."""
    def shard_of(anchor, outer=b""):
        return zlib.crc32(anchor.to_bytes(8, "little", signed=True) + outer) % shards

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0), BLOCK):
                yield from of_slice(texts, batch.column(1).slice(a, b - a).to_pylist())

    def of_slice(texts, cuts):
        out = []
        for text, pieces in zip(texts, cuts):
            words = text.encode("utf-8", "surrogatepass").split()
            for p in pieces:
                at, n = p["at"], p["n"]
                if not p["hot"]:
                    out.append((shard_of(p["anchor"]), p["anchor"], p["piece"], p["weight"], 0, b" ".join(words[at:at + n + WINDOW - 1])))
                    continue
                for i in range(n):
                    cut = words[at + i:at + i + WINDOW]
                    outer = hashlib.blake2b(b" ".join(cut[:4] + cut[-4:]), digest_size=8).digest()
                    out.append((shard_of(p["anchor"], outer), p["anchor"], p["piece"], p["weight"], i, b" ".join(cut)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["shard", "anchor", "piece", "weight", "first", "words"])

    return run


def shard_repeats(words: list[bytes], weights: np.ndarray, window: int = WINDOW) -> list[int]:
    """For each sequence (words joined by a space) the windows that occur twice or more in the shard, as bits.

    Equal sequences are indexed once, with their weights added up.
    """
    place: dict[bytes, int] = {}
    at = np.array([place.setdefault(w, len(place)) for w in words])
    weight = np.bincount(at, weights, minlength=len(place)).astype(np.int64)
    vocabulary: dict[bytes, int] = {}
    symbols, lengths = [], []
    for sequence in place:
        line = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in sequence.split(b" ")]
        symbols += line
        symbols.append(0)
        lengths.append(len(line))
    symbols, lengths = np.array(symbols, np.int64), np.array(lengths)
    ends = np.cumsum(lengths + 1) - 1
    index = FMIndex(symbols, np.repeat(weight, lengths + 1), int(lengths.max()) + 1)
    flags = repeated_windows(index, symbols, ends - lengths, ends, window, 2)
    bits = [int(sum(1 << i for i in np.flatnonzero(flags[e - n:e]).tolist())) for e, n in zip(ends, lengths)]
    return [bits[i] for i in at]


def _search(batches):
    """Shard after shard: builds its index and reports windows per piece as bits."""
    def report(rows):
        anchor, piece, weight, first, words = zip(*rows)
        bits = shard_repeats(list(words), np.array(weight))
        hit = [i for i, b in enumerate(bits) if b]
        return pa.RecordBatch.from_arrays(
            [pa.array([anchor[i] for i in hit], pa.int64()), pa.array([piece[i] for i in hit], pa.int64()),
             pa.array([bits[i] << first[i] for i in hit], pa.int64())], names=["anchor", "piece", "mask"])

    now, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for shard, *row in zip(*columns):
            if shard != now:
                if held:
                    yield report(held)
                now, held = shard, []
            held.append(row)
    if held:
        yield report(held)


def find_repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` is id (a unique number), text, name. Returns (described documents, id with its repeated window runs)."""
    described = staged(texts.mapInArrow(_describe, _DESCRIBED), "pieces", TEXT_BATCH)
    n_pieces = described.agg(F.coalesce(F.sum(F.size("pieces")), F.lit(0))).first()[0]
    buckets = max(8, 1 << int(np.ceil(np.log2(n_pieces / BUCKET_ROWS + 1))))
    repeated = staged(
        described.filter(F.size("pieces") > 0).select("id", "pieces").mapInArrow(_packed(buckets), "bucket int, packed binary")
        .repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, _REPEATED), "repeated", TEXT_BATCH)
    n_words = repeated.agg(F.coalesce(F.sum(F.when(F.col("hot"), F.col("n") * WINDOW).otherwise(F.col("n") + WINDOW)), F.lit(0))).first()[0]
    shards = max(8, -(-n_words // SHARD_WORDS))
    by_text = repeated.groupBy(F.col("doc").alias("id")).agg(
        F.collect_list(F.struct("anchor", "piece", "weight", "at", "n", "hot")).alias("cuts"))  # at most the document's pieces
    cut = by_text.join(texts, "id").select("text", "cuts").mapInArrow(_cut(shards), _CUT)
    masks = staged(
        cut.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_search, "anchor long, piece long, mask long")
        .groupBy("anchor", "piece").agg(F.bit_or("mask").alias("mask")), "masks", TEXT_BATCH)
    discard(repeated)
    places = described.select("id", F.inline("pieces")).join(masks, ["anchor", "piece"])
    return described, places.groupBy("id").agg(F.collect_list(F.struct("at", "mask")).alias("runs"))


def covered_words(n_words: int, runs) -> np.ndarray:
    """Which words a repeated window covers."""
    steps = np.zeros(n_words + 1, np.int64)
    for run in runs:
        at, mask = run["at"], run["mask"]
        while mask:
            low = mask & -mask
            start = at + low.bit_length() - 1
            steps[start] += 1
            steps[start + WINDOW] -= 1
            mask ^= low
    return np.cumsum(steps[:-1]) > 0


def _kept(text: str, runs) -> tuple[list[bytes], int]:
    words = text.encode("utf-8", "surrogatepass").split()
    gone = covered_words(len(words), runs)
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by a space)."""
    def digest(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), BLOCK):
                rows = [_kept(t, r) for t, r in zip(texts, batch.column(2).slice(a, b - a).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([n for _, n in rows], pa.int64()),
                     pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows])], names=["id", "n_removed", "kept"])

    rows = numbered(docs, "_row")
    texts = rows.select(F.col("_row").alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("name"))
    described, runs = find_repeats(texts)
    touched = runs.join(texts.drop("name"), "id").select("id", "text", "runs").mapInArrow(digest, "id long, n_removed long, kept string")
    return described.drop("pieces").join(touched, "id", "left").select(
        F.col("name").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the covered words; texts that lose none stay as they are, byte for byte."""
    @F.arrow_udf("string")
    def kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
        parts = [pa.array([
            t if t is None or not r else b" ".join(_kept(t, r)[0]).decode("utf-8", "surrogatepass")
            for t, r in zip(some, runs.slice(a, b - a).to_pylist())], pa.string()) for a, b, some in text_slices(texts, BLOCK)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    rows = numbered(docs, "_row")
    _, runs = find_repeats(rows.select(F.col("_row").alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("name")))
    joined = rows.join(runs.select(F.col("id").alias("_row"), F.col("runs").alias("_runs")), "_row", "left")
    return joined.withColumn(text_col, F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(
        kept(F.col(text_col), F.col("_runs")))).drop("_row", "_runs")


def query_substring(spark, sf_dir):
    return repeat_digest(read_table(spark, sf_dir, "documents"))
