"""Alignment of two tokenizers' tokens of the same text by divide and conquer at shared cuts.

Both tokenizers cover the bytes of a text, so their tokens end at byte offsets. ``shared_groups`` starts with
whole texts as intervals: in each it looks for an offset near the middle where tokens of both end, by
bisecting the other side's ends for the middle token's end and then for its neighbours, farther and farther.
Where it finds one, the interval is cut there and both halves go on; an interval without a cut is a group of
tokens of both sides that belong together. All intervals of a block of texts take a step at once, in numpy.

Within a group the elementary spans between neighbouring ends are the links: pairs of tokens with
overlapping bytes. ``align_documents`` counts in how many documents each pair of ids is linked and holds
every link against the best pair of its first id.

Spark deals documents to blocks. A block keeps its distinct pairs of ids once, and per document which of them
it has how often. Pairs of blocks are counted per pair and go back to their blocks, so a frequent pair
sends one row per block to the shuffle, never one per document. Rows of a text stay one row throughout.

Texts are cut into pieces before spaces, where no token of either side goes across, and a task encodes each
distinct piece once while its cache holds it; where a piece's tokens do not spell the piece, the whole text is encoded and compared.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text,
have no tokens: zeros and the empty digest. Repeated rows and ids each count as documents. An empty table
gives no rows. Texts are read whole. Only id and text are used of other columns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrag.llm.common import mix, read_table, slices
from corrag.session import staged

#: Bytes of text that are aligned at once; a longer text stands alone.
BLOCK = 1 << 20
#: Characters of all pieces that a task remembers, and the longest piece that it remembers.
REMEMBERED, LONG_PIECE = 1 << 23, 256
#: Plain pieces that go to a tokenizer as one text.
JOINED = 64
#: Entries of pairs in a bucket, about, and entries that a task adds up at once.
BUCKET_ROWS, ADDED = 1 << 22, 1 << 21
_SPACE_CUT = re.compile(r"(?<=\S)(?= )")
#: White space beside a space, or at an end of the text.
_RUNS = re.compile(r"\s | \s|^\s|\s$")
_SPACE = "▁"


def text_pieces(text: str) -> list[str]:
    """The text with a space before it, cut in front of spaces: behind a character that is not white space,
    or any single space with something else than white space on its right."""
    if _RUNS.search(text) or not text:
        return _SPACE_CUT.split(" " + text)
    return [" " + p for p in text.split(" ")]


def byte_level_side(path: str) -> Side:
    """A byte-level tokenizer as a side; the strings of its special tokens are plain text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    # The alphabet of byte-level tokens: printable Latin-1 characters stand for themselves, the others follow from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    spelled = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        spelled[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return Side(lambda texts: [e.ids for e in many(texts, add_special_tokens=False)], spelled)


def piece_side(path: str) -> Side:
    """A SentencePiece model as a side; it puts a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return Side(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), spelled)


class Side:
    """One tokenizer: ids of texts that begin with a space, and the bytes of each id."""

    def __init__(self, encode: Callable, spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.n_bytes = np.array([len(s) for s in spelled], np.int64)

    def each(self, pieces: list[str], raws: list[bytes]) -> list[bytes | None]:
        """The ids of each piece as packed 16-bit numbers; None where their bytes differ from it."""
        return [np.array(ids, np.uint16).tobytes() if b"".join([self.spelled[i] for i in ids]) == raw else None
                for ids, raw in zip(self.encode(pieces), raws)]

    def many(self, groups: list[list[str]], raws: list[list[bytes]]) -> list[list[bytes | None]]:
        """The same for groups of plain pieces, each group encoded as one text and cut where its pieces end."""
        out = []
        for pieces, raw, ids in zip(groups, raws, self.encode(["".join(g) for g in groups])):
            wanted = np.cumsum([len(r) for r in raw])
            ends = np.cumsum(self.n_bytes[ids])
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] < len(ends) and (ends[at] == wanted).all() and b"".join([self.spelled[i] for i in ids]) == b"".join(raw):
                packed, stops = np.array(ids, np.uint16).tobytes(), [0, *(2 * at + 2).tolist()]
                out.append([packed[a:b] for a, b in zip(stops, stops[1:])])
            else:
                out.append(self.each(pieces, raw))
        return out


class Encoder:
    """Ids of both sides for pieces of texts, each distinct piece encoded once while it is remembered."""

    def __init__(self, first: Side, second: Side):
        self.sides = first, second
        self._clear()

    def _clear(self):
        self._known: dict[str, tuple[bytes, bytes] | None] = {}
        self._held = 0

    def _learn(self, pieces: list[str]) -> dict:
        plain, odd = [], []  # a plain piece may stand behind and before any other one
        for p in pieces:
            (plain if 1 < len(p) <= LONG_PIECE and not p[1].isspace() and not p[-1].isspace() else odd).append(p)
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        raws = [[p.encode("utf-8", "surrogatepass") for p in g] for g in groups]
        a, b = (side.many(groups, raws) for side in self.sides)
        found = {p: None if x is None or y is None else (x, y)
                 for g, xs, ys in zip(groups, a, b) for p, x, y in zip(g, xs, ys)}
        if odd:
            raw = [p.encode("utf-8", "surrogatepass") for p in odd]
            found.update((p, None if x is None or y is None else (x, y)) for p, x, y in zip(odd, *(side.each(odd, raw) for side in self.sides)))
        return found

    def ids(self, texts: list[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """For each text, given as its pieces, the ids of both sides; empty where the joined bytes differ."""
        if self._held > REMEMBERED:
            self._clear()
        known = self._known
        learned = self._learn([p for p in dict.fromkeys(chain.from_iterable(texts)) if p not in known])
        passing = {p: f for p, f in learned.items() if len(p) > LONG_PIECE}
        for p, f in learned.items():
            if len(p) <= LONG_PIECE:
                known[p] = f
                self._held += len(p)
        a, b = [], []
        for pieces in texts:
            found = [known[p] if p in known else passing[p] for p in pieces] if passing else list(map(known.__getitem__, pieces))
            if None in found:  # pieces do not tell whether the whole text differs
                whole = "".join(pieces)
                found = [self._learn([whole])[whole] or (b"", b"")]
            a.append(b"".join([f[0] for f in found]))
            b.append(b"".join([f[1] for f in found]))
        return a, b


def _bisect(ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted offset in ascending ends."""
    place = np.searchsorted(ends, wanted)
    return place, ends[np.minimum(place, len(ends) - 1)] == wanted


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_last: np.ndarray) -> np.ndarray:
    """Numbers of the first side's tokens that close a group, ascending.

    ``a_ends`` and ``b_ends`` are ascending offsets over a block of texts; ``a_last`` are the numbers of the
    first side's last tokens of each text, whose ends both sides share."""
    if not len(a_last):
        return a_last
    found = [a_last]
    low, high = np.concatenate(([0], a_last[:-1] + 1)), a_last  # tokens whose ends may cut: low to high - 1
    while len(low):
        open_ = high > low
        low, high = low[open_], high[open_]
        middle, cut = (low + high - 1) // 2, np.full(len(low), -1)
        todo, step = np.arange(len(low)), 0
        while len(todo):
            # One step away from the middle: right, then left of it.
            for side in ((1, -1) if step else (1,)):
                at = middle[todo] + side * step
                inside = (at >= low[todo]) & (at < high[todo])
                _, there = _bisect(b_ends, a_ends[at[inside]])
                cut[todo[inside][there]] = at[inside][there]
                todo = todo[cut[todo] < 0]
            step += 1
            todo = todo[(middle[todo] + step < high[todo]) | (middle[todo] - step >= low[todo])]
        has = cut >= 0
        low, high, cut = low[has], high[has], cut[has]
        found.append(cut)
        low, high = np.concatenate((low, cut + 1)), np.concatenate((cut, high))
    return np.sort(np.concatenate(found))


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of both sides of every elementary span between neighbouring ends."""
    spans = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, spans), np.searchsorted(b_ends, spans)


def group_strings(a_ids, b_ids, a_text_ends, closes, b_closes) -> list[bytes]:
    """Per text ``a1,a2|b1;a3|b2,b3``: ids of each group in decimal. ``closes`` and ``b_closes`` are the numbers
    of the tokens that close the groups, ``a_text_ends`` the number of first-side tokens up to each text's end."""
    n_groups = len(closes)
    a_sizes, b_sizes = np.diff(closes, prepend=-1), np.diff(b_closes, prepend=-1)
    total = len(a_ids) + len(b_ids)
    # Tokens in the order of the digest: those of a group's first side, then those of its second side.
    before = np.concatenate(([0], np.cumsum(a_sizes + b_sizes)))[:n_groups]
    a_at = np.arange(len(a_ids)) + np.repeat(before - (np.cumsum(a_sizes) - a_sizes), a_sizes)
    b_at = np.arange(len(b_ids)) + np.repeat(before + a_sizes - (np.cumsum(b_sizes) - b_sizes), b_sizes)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_at[closes]], mark[b_at[b_closes]] = ord("|"), ord(";")
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000)
    stops = np.cumsum(digits + 1)  # behind the mark that follows an id
    out = np.empty(int(stops[-1]) if total else 0, np.uint8)
    out[stops - 1] = mark
    rest = ids
    for d in range(5):
        has = digits > d
        out[stops[has] - 2 - d] = 48 + rest[has] % 10
        rest = rest // 10
    raw = out.tobytes()
    last_group = np.searchsorted(closes, a_text_ends)  # groups up to each text's end
    text_stops = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(a_sizes + b_sizes)))[last_group]]
    starts = np.concatenate(([0], text_stops[:-1]))
    return [raw[s:e - 1] if e > s else b"" for s, e in zip(starts.tolist(), text_stops.tolist())]


def align_block(texts: list[list[str]], encoder: Encoder):
    """Of texts given as their pieces: n_a, n_b, n_groups, n_links and the group string of each text; and
    (text, pair, times), the distinct linked pairs ``a << 32 | b`` of each text and how often it has them."""
    a_packed, b_packed = encoder.ids(texts)
    a_ids, b_ids = (np.frombuffer(b"".join(p), np.uint16).astype(np.int64) for p in (a_packed, b_packed))
    n_a, n_b = (np.array([len(x) // 2 for x in p], np.int64) for p in (a_packed, b_packed))
    a_ends, b_ends = (np.cumsum(side.n_bytes[ids]) for side, ids in zip(encoder.sides, (a_ids, b_ids)))
    a_text = np.cumsum(n_a)
    closes = shared_groups(a_ends, b_ends, a_text[n_a > 0] - 1)
    strings = group_strings(a_ids, b_ids, a_text, closes, np.searchsorted(b_ends, a_ends[closes]))
    a_at, b_at = links(a_ends, b_ends)
    owner = np.searchsorted(a_text, a_at, "right")
    counts = n_a, n_b, np.diff(np.searchsorted(closes, a_text), prepend=0), np.bincount(owner, minlength=len(texts))
    distinct, number = np.unique(a_ids[a_at] << 32 | b_ids[b_at], return_inverse=True)
    code, times = np.unique(owner * max(1, len(distinct)) + number, return_counts=True)
    return counts, strings, code // max(1, len(distinct)), distinct[code % max(1, len(distinct))], times


_ROWS = ("block string, id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
         "digest array<string>, pairs binary, documents binary, until array<long>, numbers binary, times binary")


def _blocks(make_encoder: Callable):
    """Rows of aligned blocks: per text its counts and digest; the block's distinct pairs and how many of its
    documents have each; which of them each text has (``numbers`` up to ``until``), and how often."""
    def run(batches):
        from pyspark import TaskContext

        encoder, task, count = None, TaskContext.get(), 0
        for batch in batches:
            encoder = encoder or make_encoder()
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices([len(t or "") + 1 for t in texts], BLOCK):
                counts, strings, owner, pair, times = align_texts(texts[a:b], encoder)
                count += 1
                pairs, number = np.unique(pair, return_inverse=True)
                documents = np.bincount(number, minlength=len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task.partitionId()}-{count}"]), _one(ids.slice(a, b - a)), *(_one(pa.array(n, pa.int64())) for n in counts),
                     _one(pa.array(strings, pa.string())), pa.array([pairs.tobytes()], pa.binary()), pa.array([documents.tobytes()], pa.binary()),
                     _one(pa.array(np.searchsorted(owner, np.arange(b - a), "right"))),
                     pa.array([number.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32).tobytes()], pa.binary()),
                     pa.array([_small(times)], pa.binary())],
                    names=[part.split()[0] for part in _ROWS.split(", ")])

    return run


def align_texts(texts: list[str | None], encoder: Encoder):
    """``align_block`` of whole texts with digests in place of the group strings; a long text must stand alone."""
    if len(texts) == 1 and len(texts[0] or "") > BLOCK:
        found = _aligned_parts(text_pieces(texts[0]), encoder)
        if found is not None:
            return found
    counts, strings, owner, pair, times = align_block([text_pieces(t) if t else [] for t in texts], encoder)
    return counts, [hashlib.sha256(s).hexdigest() if s else "" for s in strings], owner, pair, times


def _aligned_parts(pieces: list[str], encoder: Encoder):
    """A long text aligned in parts of whole pieces, whose ends both sides share; None if a part's bytes differ."""
    counts, digest, pairs, times = np.zeros(4, np.int64), hashlib.sha256(), [], []
    for a, b in slices([len(p) for p in pieces], BLOCK):
        some, strings, _, pair, n = align_block([pieces[a:b]], encoder)
        if not some[0][0]:
            return None
        counts += [int(x[0]) for x in some]
        digest.update((b";" if pairs else b"") + strings[0])
        pairs.append(pair)
        times.append(n)
    pair, number = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(number, np.concatenate(times)).astype(np.int64)
    return [[int(c)] for c in counts], [digest.hexdigest()], np.zeros(len(pair), np.int64), pair, total


def _one(values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _small(times: np.ndarray) -> bytes:
    """One byte for each number below 255, 255 for a larger one, and the larger ones behind."""
    large = times >= 255
    return np.where(large, 255, times).astype(np.uint8).tobytes() + times[large].astype(np.int64).tobytes()


def _large(packed: bytes, n: int) -> np.ndarray:
    times = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    large = times == 255
    times[large] = np.frombuffer(packed, np.int64, int(large.sum()), n)
    return times


def _pair_counts(batches):
    """``a, b, n``: documents with a pair, added up over the blocks of a task as long as they fit."""
    def flush(held):
        pairs, number = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.bincount(number, np.concatenate([d for _, d in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

    held, total = [], 0
    for batch in batches:
        for pairs, documents in zip(*(column.to_pylist() for column in batch.columns)):
            held.append((np.frombuffer(pairs, np.int64), np.frombuffer(documents, np.int64)))
            total += len(held[-1][0])
            if total > ADDED:
                yield flush(held)
                held, total = [], 0
    if total:
        yield flush(held)


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(pairs), np.int64)


_DEALT = "bucket int, block string, pairs binary, n binary, best binary"


def _dealt_batch(bucket, block, pairs, n, best):
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([block], pa.string()), pa.array([pairs.tobytes()], pa.binary()),
         pa.array([n.tobytes()], pa.binary()), pa.array([best.tobytes()], pa.binary())], names=["bucket", "block", "pairs", "n", "best"])


def _deal_counts(buckets: int):
    """The corpus-wide count of each pair and whether its first id has no better one, dealt to buckets."""
    def run(batches):
        for batch in batches:
            a, b, n, best = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            pairs = a << 32 | b
            bucket = _bucket(pairs, buckets)
            for i in np.unique(bucket).tolist():
                mine = bucket == i
                yield _dealt_batch(i, None, pairs[mine], n[mine], best[mine].astype(np.uint8))

    return run


def _deal_blocks(buckets: int):
    """What the blocks ask for, dealt to the same buckets."""
    def run(batches):
        none = np.empty(0, np.int64)
        for batch in batches:
            for block, pairs in zip(*(column.to_pylist() for column in batch.columns)):
                pairs = np.frombuffer(pairs, np.int64)
                bucket = _bucket(pairs, buckets)
                for i in np.unique(bucket).tolist():
                    yield _dealt_batch(i, block, pairs[bucket == i], none, none)

    return run


def _answer(batches):
    """Counts for the blocks, bucket by bucket; the counts of a bucket come first, then its blocks one by one."""
    now, held, table = None, [], None
    for batch in batches:
        for bucket, block, pairs, n, best in zip(*(column.to_pylist() for column in batch.columns)):
            if bucket != now:
                now, held, table = bucket, [], None
            pairs = np.frombuffer(pairs, np.int64)
            if block is None:
                held.append((pairs, np.frombuffer(n, np.int64), np.frombuffer(best, np.uint8)))
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*held)]
                order = np.argsort(table[0])
                table, held = [x[order] for x in table], []
            at = np.searchsorted(table[0], pairs)
            yield _dealt_batch(bucket, block, np.empty(0, np.int64), table[1][at], table[2][at])


def _finish(buckets: int):
    """Rows of documents from aligned blocks and the answers to them."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], np.int64)
                bucket, n, best = _bucket(pairs, buckets), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                for answer in row["answers"] or []:
                    mine = bucket == answer["bucket"]
                    n[mine], best[mine] = np.frombuffer(answer["n"], np.int64), np.frombuffer(answer["best"], np.uint8)
                number = np.frombuffer(row["numbers"], np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
                times = _large(row["times"], len(number))
                until = np.array([0, *row["until"]])
                n_best, total = (np.diff(np.concatenate(([0], np.cumsum(times * x[number])))[until]) for x in (best, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["id"], pa.int64()), *(pa.array(row[name], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(row["digest"], pa.string())],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def align_documents(docs: DataFrame, make_encoder: Callable[[], Encoder], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. ``make_encoder`` runs in the tasks."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = staged(texts.mapInArrow(_blocks(make_encoder), _ROWS), "aligned")
    counts = staged(blocks.select("pairs", "documents").mapInArrow(_pair_counts, "a long, b long, n long")
                    .groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("_most"))
    judged = counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))
    entries = blocks.agg(F.coalesce(F.sum(F.octet_length("pairs")), F.lit(0))).first()[0] // 8
    buckets = int(min(1 << 14, max(8, 1 << int(np.ceil(np.log2(entries / BUCKET_ROWS + 1))))))
    dealt = judged.mapInArrow(_deal_counts(buckets), _DEALT).unionAll(
        blocks.select("block", "pairs").mapInArrow(_deal_blocks(buckets), _DEALT))
    answers = (dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block")).mapInArrow(_answer, _DEALT)
               .groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "best")).alias("answers")))
    return (blocks.drop("documents").join(answers, "block", "left").mapInArrow(
        _finish(buckets), "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        .withColumnRenamed("id", id_col))


def query_alignment(spark: SparkSession, sf_dir: str, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path(first), public_tokenizers.path(second)
    return align_documents(read_table(spark, sf_dir, "documents"), lambda: Encoder(byte_level_side(paths[0]), piece_side(paths[1])))
