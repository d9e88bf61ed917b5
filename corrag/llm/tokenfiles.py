"""Token ids as Arrow files of fixed-size lists.

``encode_to_files`` writes one Arrow IPC file per partition, in ascending order of the document id.
A file holds the ids of its documents, one after another, cut into sequences of equal length:
``ids`` (fixed-size list), ``mask`` (fixed-size list of booleans, false in the padding of the file's
last sequence). The values of a column are one contiguous buffer, so a memory-mapped file gives any
sequence and any document without a copy. The manifest lists the files, their documents and where
each one starts. ``read_documents`` reads the files back.

Files have the name of their partition and attempt; only what the manifest lists counts, so a
repeated or speculative task leaves no wrong result. Ids are kept as 16-bit numbers where the vocabulary allows.

Defined results: a null or empty text has only the end id. Equal texts are stored each. Rows with
equal ids follow each other in the order of their texts. An empty table gives no file and no rows. Other columns are left
out.
"""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from corrag.llm.common import read_table, slices
from corrag.llm.wordcache import PieceCache, encode_words, flatten, taken
from corrag.session import new_shared_path, staged

#: Ids of one sequence.
LENGTH = 2048
#: Sequences of one record batch.
BATCH = 512
#: Bytes whose pieces are looked up at once.
BLOCK = 1 << 22
_ASCII_LETTER = np.array([chr(i) in string.ascii_letters for i in range(256)])
_MANIFEST = "file string, doc_id long, at long, n_tokens long"


def open_filesystem(uri: str):
    """The file system and path of a folder that all executors share, as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and the number of each text; some words may be empty.

    Arrow also cuts at four control marks that are no white space to the tokenizer.
    """
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        lists = pa.array([re.split(r"[ \t\n\r]+", t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _stems_and_marks(words: pa.Array) -> pa.Array:
    """Of every word its stem, ASCII letters in lower case if it has no others, and then its closing marks."""
    words = words.cast(pa.large_string())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    values = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    bare = pc.ascii_rtrim(words, string.punctuation)
    middle = bounds[:-1] + pc.binary_length(bare).to_numpy()
    cut = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
    cut[cut] = _ASCII_LETTER[values[middle[cut] - 1]]
    ends = np.empty(2 * len(words) + 1, np.int64)
    ends[::2], ends[1::2] = bounds, np.where(cut, middle, bounds[1:])
    parts = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(ends), words.buffers()[2])
    return pc.if_else(pc.string_is_ascii(parts), pc.ascii_lower(parts), parts)


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins across it.

    A run of ASCII marks at the end of a word of letters is a piece of its own to that tokenizer if an
    ASCII letter stands before it, so words are cut there. Each distinct piece is encoded once per
    task. Pieces of letters alone have one id that ends a word; they go to the tokenizer many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor share its cores
        tokenizer = Tokenizer.from_file(path)
        self._many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        size = tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        suffix = tokenizer.model.end_of_word_suffix
        self._ends = np.zeros(size, bool)
        if suffix:
            self._ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._joins = bool(suffix)
        self._cache = PieceCache(self.dtype)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._many(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self._joins and p.isalpha() for p in pieces]
        a, m = encode_words([p for p, one in zip(pieces, plain) if one], self._encode, self._ends, True, self.dtype)
        b, n = flatten(self._encode([p for p, one in zip(pieces, plain) if not one]), self.dtype)
        place = np.empty(len(pieces), np.int64)
        place[np.argsort(~np.array(plain, bool), kind="stable")] = np.arange(len(pieces))
        return taken(np.concatenate((a, b)), np.concatenate((m, n)), place)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids per text."""
        words, per_text = split_words(texts)
        words = words.dictionary_encode()
        distinct, at = words.dictionary, words.indices.to_numpy()
        pieces = _stems_and_marks(distinct).dictionary_encode()
        flat, counts = self._cache.lookup(pieces.dictionary.to_pylist(), self._new)
        flat, both = taken(flat, counts, pieces.indices.to_numpy())
        flat, per_word = taken(flat, both.reshape(-1, 2).sum(axis=1), at)
        before = np.concatenate(([0], np.cumsum(per_word)))
        return flat, np.diff(before[np.cumsum(per_text)], prepend=0)


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype):
        self._kind = pa.list_(pa.from_numpy_dtype(dtype), LENGTH)
        self._schema = pa.schema([("ids", self._kind), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self._file, self._dtype, self._rest = pa.ipc.new_file(sink, self._schema), dtype, [np.empty(0, dtype)]
        self._held, self.written = 0, 0

    def add(self, ids: np.ndarray):
        self._rest.append(ids)
        self._held += len(ids)
        if self._held >= LENGTH * BATCH:
            whole = np.concatenate(self._rest)
            cut = len(whole) // (LENGTH * BATCH) * (LENGTH * BATCH)
            for i in range(0, cut, LENGTH * BATCH):
                self._put(whole[i:i + LENGTH * BATCH], LENGTH * BATCH)
            self._rest, self._held = [whole[cut:]], len(whole) - cut

    def _put(self, values, real):
        mask = np.arange(len(values)) < real
        self._file.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(values), LENGTH),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH)], schema=self._schema))

    def close(self):
        whole = np.concatenate(self._rest)
        if len(whole):
            padded = np.zeros(-(-len(whole) // LENGTH) * LENGTH, self._dtype)
            padded[:len(whole)] = whole
            self._put(padded, len(whole))
        self._file.close()


def encode_to_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: file, doc_id, at (in the file), n_tokens. Staged."""
    def write(batches):
        from pyspark import TaskContext

        task, name = TaskContext.get(), None
        place, writer, encoder = 0, None, None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            if writer is None:
                encoder = WordEncoder(tokenizer_path)
                system, root = open_filesystem(folder)
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
                sink = system.open_output_stream(f"{root}/{name}")
                writer = _Writer(sink, encoder.dtype)
            for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), BLOCK):
                flat, counts = encoder.ids(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                writer.add(np.insert(flat, ends, encoder.dtype(end_id)))
                counts = counts + 1
                starts = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (b - a)), ids.slice(a, b - a), pa.array(starts), pa.array(counts)],
                    names=["file", "doc_id", "at", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    system, root = open_filesystem(folder)
    system.create_dir(root, recursive=True)
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return staged(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


class TokenFile:
    """Random access to one file: ``sequence(i)``, ``mask(i)`` and ``span(at, n)`` of the id stream."""

    def __init__(self, system, path: str):
        from pyarrow import fs

        local = isinstance(system, fs.LocalFileSystem)
        self._file = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))

    def _values(self, batch: int, column: int = 0):
        return self._file.get_batch(batch).column(column).flatten().to_numpy(zero_copy_only=column == 0)

    def sequence(self, i: int) -> np.ndarray:
        return self._values(i // BATCH)[i % BATCH * LENGTH:][:LENGTH]

    def mask(self, i: int) -> np.ndarray:
        return self._values(i // BATCH, 1)[i % BATCH * LENGTH:][:LENGTH]

    def span(self, at: int, n: int) -> np.ndarray:
        size, parts = LENGTH * BATCH, []
        while n > 0:
            part = self._values(at // size)[at % size:][:n]
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and the file."""
    def digest(batches):
        opened: dict[str, TokenFile] = {}
        system, root = open_filesystem(folder)
        for batch in batches:
            rows = batch.to_pydict()
            crcs = []
            for file, at, n in zip(rows["file"], rows["at"], rows["n_tokens"]):
                if file not in opened:
                    opened.clear()
                    opened[file] = TokenFile(system, f"{root}/{file}")
                crcs.append(zlib.crc32(opened[file].span(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("file", "doc_id", "at", "n_tokens")), pa.array(crcs, pa.int64())],
                names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = manifest.mapInArrow(digest, _MANIFEST + ", ids_crc32 long")
    files = manifest.groupBy("file").agg(F.sum("n_tokens").alias("_size"))  # one row per file
    before = files.select("file", (F.sum("_size").over(Window.orderBy("file")) - F.col("_size")).alias("_before"))
    return read.join(before, "file").select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file")


def query_token_files(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    import public_tokenizers

    folder = new_shared_path(spark, "token-files")
    manifest = encode_to_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(vocabulary), end_id)
    return read_documents(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
