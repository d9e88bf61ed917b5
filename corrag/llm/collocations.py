"""Phrase collocations by dynamic itemset counting.

The words of every text are dealt to ``SHARDS`` shards, which are scanned in a cycle. A scan counts phrases
of all lengths that are active: words from the start, a longer phrase from the scan after its two
subphrases (all words but the last, all words but the first) have both reached the threshold. Each phrase
is counted for exactly one full cycle, wherever in the cycle it started, so its count is exact; the scans
end when no phrase can start any more and the last one has completed its cycle.

Which phrases are active is sent to the tasks as tables of fixed size (``MOST_SLOTS`` bytes a length at most): the
slot of a phrase holds the scan in which a phrase of that slot reached the threshold. Two phrases in one
slot only make some phrase active that need not be; such a phrase stays below the threshold or is
counted whole. Counts of phrases in their cycle live in a table dealt by phrase, in packed blocks; a
phrase that ends its cycle below the threshold leaves it. Only slot tables reach the driver.

Scoring works on hashes: the words of the frequent phrases are looked up in the first shard, and those it
does not have in the others. Only phrases that rank get their text, from one more pass over the documents.

Phrases are told apart by 64-bit hashes of language and words.

Defined results: null text has no words, null language is ``und``, which it shares with a language of that
name. Repeated rows count as often as they stand there. Very long texts are hashed part by
part, cut between words, and their pieces put together again. An empty table gives no rows. Only
text and language are used of other columns.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrag.llm.common import delete_folder, discard, mix, read_table, slices
from corrag.llm.shingles import word_hashes
from corrag.session import new_shared_path, staged

#: Shards of a cycle.
SHARDS = 3
#: Slots of the table of each length that says when phrases reached the threshold: as many as phrases can
#: reach it, between these bounds. A slot takes a byte.
FEWEST_SLOTS, MOST_SLOTS = 1 << 18, 1 << 25
#: Words of the longest phrase.
LONGEST = 4
#: Bytes of text that are cut into words at once, and words that a task counts at once.
BLOCK, COUNTED = 1 << 20, 1 << 21
#: Entries of a counting bucket, about.
BUCKET_ROWS = 1 << 20
_NEVER = 255
#: What ends a piece, and what lies between words (fixed values).
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ANY_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_IS_BREAK, _IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True
_IS_GAP[list(_GAPS + _BREAKS)] = True


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def cut_words(texts: list[bytes]):
    """(bytes, starts, ends, owner, piece) of all words; words of one piece have the same number."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _IS_GAP[data]
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    piece = np.cumsum(_IS_BREAK[data])[starts]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    return data, starts, ends, owner, piece


def language_seed(lang: str) -> np.uint64:
    raw = lang.encode("utf-8", "surrogatepass")
    return mix(np.array([zlib.crc32(raw) << 32 | zlib.adler32(raw)], np.uint64))[0]


def _longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of ``k`` words from those without the last word and that word."""
    return mix(h * np.uint64(0xFF51AFD7ED558CCD) + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k))


def phrase_hashes(words: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """For each length the hash of the phrase from each word on; 0 where the piece is too short."""
    found = [words]
    for k in range(2, LONGEST + 1):
        n = max(0, len(words) - k + 1)
        h = _longer(found[-1][:n], words[k - 1:], k)
        h[piece[:n] != piece[k - 1:]] = 0
        found.append(h)
    return found


def _blocks(batch):
    """(rows' seeds, lowered texts) in blocks; ``batch`` has text and language."""
    texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    raw = [lowered(t) for t in texts]
    seeds = {lang: language_seed(lang) for lang in set(langs)}
    for a, b in slices([len(t) + 1 for t in raw], BLOCK):
        yield np.array([seeds[x] for x in langs[a:b]], np.uint64), raw[a:b], langs[a:b]


def _seeded(seeds, block):
    """(spans, owner, piece, hashes) of the words of a block; ``spans`` is (bytes, starts, ends) per part of it."""
    if len(block) > 1 or len(block[0]) <= BLOCK:
        parts = [block]
    else:
        parts = [[part] for part in _parts(block[0])]
    spans, owners, pieces, hashes, before = [], [], [], [], 0
    for part in parts:
        data, starts, ends, owner, piece = cut_words(part)
        h = mix(word_hashes(data, starts, ends) ^ seeds[owner])
        spans.append((data, starts, ends))
        owners.append(owner)
        pieces.append(piece + before)
        hashes.append(np.where(h == 0, np.uint64(1), h))
        before += int(np.count_nonzero(_IS_BREAK[data[:-1]]))
    return spans, np.concatenate(owners), np.concatenate(pieces), np.concatenate(hashes)


def _parts(raw: bytes):
    """A long text in parts of about a block, each but the first beginning with what ends a word."""
    at = 0
    while len(raw) - at > BLOCK:
        gap = _ANY_GAP.search(raw, at + BLOCK)
        if gap is None:
            break
        yield raw[at:gap.start()]
        at = gap.start()
    yield raw[at:]


def _hashed(batches):
    """Rows of (shard, lang, words, packed word hashes with a zero behind each piece), one language a row."""
    turn = 0
    for batch in batches:
        for seeds, block, langs in _blocks(batch):
            _, owner, piece, hashes = _seeded(seeds, block)
            ends = np.flatnonzero(np.diff(piece, append=-1)) + 1
            packed = np.insert(hashes, ends, np.uint64(0))
            of_row = np.insert(owner, ends, owner[ends - 1])
            names = sorted(set(langs))
            kind = np.array([names.index(x) for x in langs])[of_row]
            for k, lang in enumerate(names):
                mine = packed[kind == k]
                turn += 1
                cuts = _even_cuts(mine, SHARDS)  # every shard gets a part, with whole pieces
                for i in range(SHARDS):
                    part = mine[cuts[i]:cuts[i + 1]]
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([(turn + i) % SHARDS], pa.int32()), pa.array([lang]), pa.array([int(np.count_nonzero(part))]),
                             pa.array([part.tobytes()], pa.binary())], names=["shard", "lang", "words", "packed"])


def _even_cuts(packed: np.ndarray, parts: int) -> list[int]:
    """Positions that cut ``packed`` into about equal parts, each behind a zero."""
    zeros = np.flatnonzero(packed == 0) + 1
    cuts = [0]
    for i in range(1, parts):
        at = np.searchsorted(zeros, len(packed) * i // parts)
        cuts.append(max(cuts[-1], int(zeros[at]) if at < len(zeros) else len(packed)))
    return [*cuts, len(packed)]


def _slot(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The places of hashes in a table whose length is a power of two."""
    return (h >> np.uint64(64 - (len(table).bit_length() - 1))).astype(np.int64)


def _starts(reached: list[np.ndarray], hashes: list[np.ndarray]) -> list[np.ndarray]:
    """For each length, from which scan on the phrase at each place is active."""
    found = [np.where(hashes[0] == 0, np.uint8(_NEVER), np.uint8(0))]
    for k in range(2, LONGEST + 1):
        part = hashes[k - 2]
        since = np.where(part == 0, np.uint8(_NEVER), reached[k - 2][_slot(part, reached[k - 2])])
        n = len(hashes[k - 1])
        both = np.maximum(since[:n], since[1:n + 1])
        found.append(np.where((hashes[k - 1] == 0) | (both == _NEVER), np.uint8(_NEVER), both + np.uint8(1)))
    return found


#: What a scan writes: counts of phrases in their cycle, slots that reached the threshold, counts of phrases
#: that have completed their cycle.
_RUNNING, _REACHED, _DONE = 0, 1, 2
_COUNTED = "bucket int, k int, start int, packed binary, kind int"


def _counts_batch(bucket, k, start, packed, kind):
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([k] * n, pa.int32()), pa.array([start] * n, pa.int32()), pa.array(packed, pa.binary()),
         pa.array([kind] * n, pa.int32())], names=["bucket", "k", "start", "packed", "kind"])


def _active(sent, scan: int, buckets: int):
    """Phrases that are active in this scan, counted per block of words, dealt to buckets by hash.

    A phrase is counted in the scans ``start`` to ``start + SHARDS - 1``."""
    firsts = np.arange(buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1))

    def flush(held):
        words = np.concatenate(held)
        hashes = phrase_hashes(words, np.cumsum(words == 0))
        hashes = [np.where(words[:len(h)] == 0, np.uint64(0), h) for h in hashes]
        for k, (h, since) in enumerate(zip(hashes, _starts(sent.value, hashes)), 1):
            for start in range(max(0, scan - SHARDS + 1), scan + 1):
                found, counts = np.unique(h[since == start], return_counts=True)
                cuts = np.append(np.searchsorted(found, firsts), len(found))
                filled = np.flatnonzero(np.diff(cuts))
                n = len(filled)
                if n:
                    yield _counts_batch(filled, k, start, [
                        _pack(found[cuts[i]:cuts[i + 1]], counts[cuts[i]:cuts[i + 1]]) for i in filled], _RUNNING)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(np.frombuffer(packed, np.uint64))
                total += len(held[-1])
                if total > COUNTED:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Their number, the hashes, one byte for each count with 255 for a larger one, and the larger ones."""
    large = counts >= 255
    return b"".join((np.uint64(len(hashes)).tobytes(), hashes.tobytes(), np.where(large, 255, counts).astype(np.uint8).tobytes(),
                     counts[large].astype(np.int64).tobytes()))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.uint64, 1)[0])
    hashes = np.frombuffer(packed, np.uint64, n, 8)
    counts = np.frombuffer(packed, np.uint8, n, 8 + 8 * n).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(packed, np.int64, int(large.sum()), 8 + 9 * n)
    return hashes, counts


def _added(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    unpacked = [_unpack(p) for p in parts]
    hashes, counts = np.concatenate([h for h, _ in unpacked]), np.concatenate([c for _, c in unpacked])
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first)


def _runs(batches):
    """(bucket, k, start, packed parts) of runs of rows; one run is held at a time."""
    now, held = None, []
    for batch in batches:
        for *key, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != now:
                if held:
                    yield *now, held
                now, held = key, []
            held.append(packed)
    if held:
        yield *now, held


def _add_up(scan: int, threshold: int, sent, buckets: int):
    """The counts of one bucket, length and start, added up, and what follows from them. A bucket holds a
    range of hashes and so a range of slots."""
    def run(batches):
        for bucket, k, start, held in _runs(batches):
            hashes, counts = _added(held)
            often = counts >= threshold
            table = sent.value[k - 1]
            width = len(table) // buckets
            slots = _slot(hashes[often], table) - bucket * width
            bits = np.zeros(width, bool)
            bits[slots[table[slots + bucket * width] == _NEVER]] = True
            if bits.any():
                yield _counts_batch([bucket], k, start, [np.packbits(bits).tobytes()], _REACHED)
            if start + SHARDS - 1 > scan:
                yield _counts_batch([bucket], k, start, [_pack(hashes, counts)], _RUNNING)
            elif often.any():
                yield _counts_batch([bucket], k, start, [_pack(hashes[often], counts[often])], _DONE)

    return run


def _frequent(batches):
    """``k, h, n`` of packed counts."""
    for batch in batches:
        for k, packed in zip(*(column.to_pylist() for column in batch.columns)):
            hashes, counts = _unpack(packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hashes), k), pa.int32()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["k", "h", "n"])


def _power_of_two(n: float, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1.0, n)))))))


def count_phrases(hashed: DataFrame, threshold: int, n_words: int) -> tuple[DataFrame, list[np.ndarray]]:
    """``k, h, n`` of all phrases of up to ``LONGEST`` words that stand there ``threshold`` times or more, staged,
    and per length the table of slots with such a phrase. ``hashed`` has columns shard and packed."""
    spark = hashed.sparkSession
    buckets = _power_of_two(n_words / BUCKET_ROWS, 8, 1 << 14)
    slots = _power_of_two(n_words / threshold, FEWEST_SLOTS, MOST_SLOTS)
    reached = [np.full(slots, _NEVER, np.uint8) for _ in range(LONGEST)]
    width = slots // buckets
    running, done, paths, scan, last = None, [], [], 0, 0
    while scan < last + SHARDS:  # ``last``: the latest start of any phrase
        sent = spark.sparkContext.broadcast(reached)
        counted = hashed.filter(F.col("shard") == scan % SHARDS).select("packed").mapInArrow(_active(sent, scan, buckets), _COUNTED)
        both = counted if running is None else counted.unionAll(running.select(counted.columns))
        path = new_shared_path(spark, "phrase-counts")
        (both.drop("kind").repartition(buckets, "bucket").sortWithinPartitions("bucket", "k", "start")
         .mapInArrow(_add_up(scan, threshold, sent, buckets), _COUNTED).write.partitionBy("kind").parquet(path))
        now = spark.read.schema(_COUNTED).parquet(path)
        for row in now.filter(F.col("kind") == _REACHED).toLocalIterator():  # an eighth of the slots in bytes, a length and start
            span = reached[row.k - 1][row.bucket * width:(row.bucket + 1) * width]
            span[np.unpackbits(np.frombuffer(row.packed, np.uint8)).astype(bool)] = scan
            if row.k < LONGEST:
                last = scan + 1
        if running is not None:
            delete_folder(spark, f"{paths[-1]}/kind={_RUNNING}")
        paths.append(path)
        done.append(now.filter(F.col("kind") == _DONE))
        running, scan = now.filter(F.col("kind") == _RUNNING), scan + 1
        sent.unpersist()
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    frequent = staged(whole.select("k", "packed").mapInArrow(_frequent, "k int, h long, n long"), "phrases")
    for path in paths:
        delete_folder(spark, path)
    return frequent, reached


def slot_tables(phrases: DataFrame, slots: int) -> list[np.ndarray]:
    """Per length a table of the slots of the phrases ``k, h``, 0 for a slot that has one."""
    width = 1 << 15

    def marked(batches):
        for batch in batches:
            ks, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            places = (hashes >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)
            for k in np.unique(ks).tolist():
                mine = np.unique(places[ks == k])
                for chunk in np.unique(mine // width).tolist():
                    bits = np.zeros(width, bool)
                    bits[mine[mine // width == chunk] % width] = True
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int32()),
                                                      pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["k", "chunk", "bits"])

    tables = [np.full(slots, _NEVER, np.uint8) for _ in range(LONGEST)]
    dealt = phrases.select("k", "h").repartition("k", F.shiftrightunsigned("h", 64 - (slots.bit_length() - 1) + 15))
    for row in dealt.mapInArrow(marked, "k int, chunk int, bits binary").toLocalIterator():
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
        tables[row.k - 1][row.chunk * width:][:width][bits[:slots]] = 0
    return tables


_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_SPELLED = "lang string, k int, h long, " + ", ".join(f"{w} long" for w in _WORDS)


def _spelled(sent):
    """The word hashes of phrases of two words or more whose slot is marked, each once a block of words."""
    def flush(held, langs):
        words, langs = np.concatenate(held), pa.array(langs)
        ends = np.cumsum([len(x) for x in held])
        hashes = phrase_hashes(words, np.cumsum(words == 0))
        for k in range(2, LONGEST + 1):
            h, table = hashes[k - 1], sent.value[k - 1]
            places = np.flatnonzero((h != 0) & (words[:len(h)] != 0))
            places = places[table[_slot(h[places], table)] != _NEVER]
            found, first = np.unique(h[places], return_index=True)
            places = places[first]
            if len(places):
                none = np.zeros(len(places), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(np.searchsorted(ends, places, "right"))), pa.array(np.full(len(places), k), pa.int32()),
                     pa.array(found.view(np.int64)),
                     *(pa.array(words[places + i].view(np.int64) if i < k else none) for i in range(LONGEST))],
                    names=["lang", "k", "h", *_WORDS])

    def run(batches):
        held, langs, total = [], [], 0
        for batch in batches:
            for lang, packed in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(np.frombuffer(packed, np.uint64))
                langs.append(lang)
                total += len(held[-1])
                if total > COUNTED:
                    yield from flush(held, langs)
                    held, langs, total = [], [], 0
        if held:
            yield from flush(held, langs)

    return run


def spell(hashed: DataFrame, frequent: DataFrame, reached: list[np.ndarray]) -> DataFrame:
    """The candidates, staged: h, a, lang, k and the hashes of their words (0 behind the last)."""
    spark = hashed.sparkSession
    wanted = frequent.filter("k > 1").select("h", F.col("n").alias("a"))
    columns = ["h", "a", "lang", "k", *_WORDS]

    def look(rows, tables):
        sent = spark.sparkContext.broadcast(tables)
        once = (rows.select("lang", "packed").mapInArrow(_spelled(sent), _SPELLED)
                .groupBy("h").agg(F.first("lang").alias("lang"), *(F.first(c).alias(c) for c in ("k", *_WORDS))))
        return staged(once.join(wanted, "h").select(columns), "candidates")

    found = look(hashed.filter("shard = 0"), reached)
    missing = staged(frequent.filter("k > 1").join(found.select("h"), "h", "left_anti").select("k", "h"), "missing")
    if missing.isEmpty():
        return found
    rest = look(hashed.filter("shard > 0"), slot_tables(missing, len(reached[0])))
    return found.unionAll(rest.join(missing.select("h"), "h", "left_semi").select(columns))


_CUTS = [f"{side}{cut}" for cut in range(1, LONGEST) for side in "lr"]


def _subphrases(batches):
    """For every candidate the hashes of both parts of each cut, null where there is none, and of the shorter
    candidates inside it."""
    for batch in batches:
        k = batch.column("k").to_numpy()
        sub = {(1, i): batch.column(w).to_numpy().view(np.uint64) for i, w in enumerate(_WORDS)}  # by length and place
        for m in range(2, LONGEST + 1):
            for i in range(LONGEST - m + 1):
                sub[m, i] = _longer(sub[m - 1, i], sub[1, i + m - 1], m)
        columns = []
        for cut in range(1, LONGEST):
            right = np.zeros(len(k), np.uint64)
            for m in range(1, LONGEST - cut + 1):
                right = np.where(k == cut + m, sub[m, cut], right)
            columns += [pa.array(x.view(np.int64), mask=k <= cut) for x in (sub[cut, 0], right)]
        inner = [(m, i) for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
        columns += [pa.array(sub[m, i].view(np.int64), mask=~((m < k) & (i + m <= k))) for m, i in inner]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *_CUTS, *_INNER])


_INNER = [f"i{m}{i}" for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]


def _texts_of(sent):
    """``w, word`` of words whose slot is marked, each once a block of texts."""
    def run(batches):
        for batch in batches:
            for seeds, block, langs in _blocks(batch):
                spans, owner, piece, words = _seeded(seeds, block)
                table = sent.value
                places = np.flatnonzero(table[_slot(words, table)] != _NEVER)
                found, first = np.unique(words[places], return_index=True)
                at = np.cumsum([len(starts) for _, starts, _ in spans])
                texts = []
                for i in places[first].tolist():
                    p = int(np.searchsorted(at, i, "right"))
                    data, starts, ends = spans[p]
                    i -= int(at[p] - len(starts))
                    texts.append(data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(texts, pa.string())], names=["w", "word"])

    return run


def collocations(docs: DataFrame, threshold: int = 30, best: int = 2000, factor: int = 2_000_000, covered: int = 80,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``LONGEST`` words that stands there ``a >= threshold`` times is a candidate. Its score is the
    least of ``floor(factor * a / (l + r))`` over its cuts in two parts with ``l`` and ``r`` occurrences. It goes if
    a longer candidate with its words has at least ``covered`` percent of its occurrences."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    path = new_shared_path(spark, "word-hashes")
    texts.mapInArrow(_hashed, "shard int, lang string, words long, packed binary").write.partitionBy("shard").parquet(path)
    hashed = spark.read.schema("lang string, words long, packed binary, shard int").parquet(path)
    totals = staged(hashed.groupBy("lang").agg(F.sum("words").alias("n")), "language-words")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent, reached = count_phrases(hashed, threshold, n_words)
    named = spell(hashed, frequent, reached)
    extra = ", ".join(f"{name} long" for name in (*_CUTS, *_INNER))
    candidates = staged(named.mapInArrow(
        _subphrases, f"h long, a long, lang string, k int, {', '.join(f'{w} long' for w in _WORDS)}, {extra}"), "subphrases")
    discard(named)
    delete_folder(spark, path)

    longer = (candidates.select(F.explode(F.array(*_INNER)).alias("h"), F.col("a").alias("_a")).filter("h IS NOT NULL")
              .groupBy("h").agg(F.max("_a").alias("_longer")))
    left = (candidates.join(longer, "h", "left")
            .filter(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a"))).drop("_longer", *_INNER))
    # The number of each part, by one join: a row per part, then a row per candidate again.
    sides = left.select("h", F.explode(F.array(*(F.struct(F.lit(x).alias("role"), F.col(x).alias("part")) for x in _CUTS))).alias("s"))
    counts = (sides.select("h", "s.role", "s.part").filter("part IS NOT NULL")
              .join(frequent.select(F.col("h").alias("part"), "n"), "part")
              .groupBy("h").agg(*(F.max(F.when(F.col("role") == x, F.col("n"))).alias(f"_{x}") for x in _CUTS)))
    cuts = [F.struct(
        F.expr(f"CAST({factor} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(_l{c} AS DECIMAL(20, 0)) + _r{c})").alias("score"),
        F.lit(c).alias("cut"), F.col(f"_l{c}").alias("l"), F.col(f"_r{c}").alias("r")) for c in range(1, LONGEST)]
    least = F.array_min(F.filter(F.array(*cuts), lambda x: x["score"].isNotNull()))
    scored = left.select("h", "a", "lang", *_WORDS).join(counts, "h").withColumn("_cut", least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = staged(scored.select("h", "lang", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"), *_WORDS)
                    .withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= best).drop("_rank"), "ranked")

    placed = ranked.select("h", F.posexplode(F.array(*_WORDS)).alias("pos", "w")).filter("w != 0")
    needed = placed.select(F.lit(1).alias("k"), F.col("w").alias("h"))
    sent = spark.sparkContext.broadcast(slot_tables(needed, len(reached[0]))[0])
    words = (texts.mapInArrow(_texts_of(sent), "w long, word string").join(placed.select("w").distinct(), "w", "left_semi")
             .groupBy("w").agg(F.min("word").alias("word")))
    phrases = (placed.join(words, "w").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_words"))
               .select("h", F.array_join(F.transform("_words", lambda x: x["word"]), " ").alias("phrase")))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (ranked.join(phrases, "h").withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= best)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


def query_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
