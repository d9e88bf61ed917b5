"""SentencePiece models on the backend of the tokenizers library.

``build_backend`` parses the model's protobuf and rebuilds it: normaliser (character map, extra white
space, dummy prefix, white space as ``▁``), BPE merges or unigram scores, and byte fallback. Texts are
cut into pieces where the vocabulary has no entry that crosses the cut, each distinct piece is encoded
once per task in multithreaded batches, and every piece is checked against the SentencePiece library
itself. Where the two differ the library's ids count and ``parity`` is false.

Defined results: a null or empty text has no ids, decodes to the empty text and has parity. Texts of
any length are encoded whole. Other columns stay; a column that has an output's name is replaced.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import read_table, text_slices
from corrag.llm.wordcache import PieceCache, encode_words, flatten

#: Characters whose pieces are looked up at once.
BLOCK = 1 << 19
_SPACE = "▁"
# Kinds of pieces and models in the published protobuf format (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model


def merge_rules(pieces) -> list[tuple[str, str]]:
    """Pairs of normal pieces that make up a normal piece, the best piece first."""
    place = {p.piece: i for i, p in enumerate(pieces) if p.type == _NORMAL}
    rules = []
    for piece, i in place.items():
        for cut in range(1, len(piece)):
            left, right = place.get(piece[:cut]), place.get(piece[cut:])
            if left is not None and right is not None:
                rules.append((-pieces[i].score, left, right))
    return [(pieces[a].piece, pieces[b].piece) for _, a, b in sorted(rules)]


def build_backend(path: str):
    """A ``tokenizers.Tokenizer`` for a SentencePiece model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    model = parse_model(path)
    trained, rules, pieces = model.trainer_spec, model.normalizer_spec, model.pieces
    if any(p.type == _USER_DEFINED for p in pieces) or trained.treat_whitespace_as_suffix:
        raise ValueError("models with user-defined pieces or white space as a suffix are not supported")
    if trained.model_type == _UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], trained.unk_id, trained.byte_fallback)
    elif trained.model_type == _BPE:
        core = models.BPE({p.piece: i for i, p in enumerate(pieces)}, merge_rules(pieces),
                          unk_token=pieces[trained.unk_id].piece, fuse_unk=True, byte_fallback=trained.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if rules.precompiled_charsmap:
        steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rules.add_dummy_prefix:
        steps.append(normalizers.Prepend(_SPACE))
    steps.append(normalizers.Replace(" ", _SPACE))
    backend = Tokenizer(core)
    backend.normalizer = normalizers.Sequence(steps)
    backend.decoder = decoders.Sequence([
        decoders.Replace(_SPACE, " "), decoders.ByteFallback(), decoders.Fuse(),
        *([decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else [])])
    return backend


def separable(model) -> bool:
    """Whether a text may be cut in front of white space: no piece has it behind something else."""
    rules = model.normalizer_spec
    return (rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not rules.precompiled_charsmap and model.trainer_spec.model_type == _BPE
            and not any(re.search(f"[^{_SPACE}]{_SPACE}", p.piece) for p in model.pieces))


def cut_text(text: str | None) -> list[str]:
    """Pieces of a separable model, each without the one space that stands before it."""
    if not text:
        return []
    text = text.replace(_SPACE, " ")
    pieces = text.split(" ")
    if "" not in pieces:
        return pieces
    return [piece[1:] for piece in re.findall(r" +[^ ]+(?: +$)?| +$", " " + text)]


class Codec:
    """Encodes and decodes texts; ``differing`` holds the pieces whose ids the backend got wrong."""

    def __init__(self, path: str):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of one batch; tasks share an executor's cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        model = parse_model(path)
        self.backend = build_backend(path)
        self._reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self._separable = separable(model)
        self._cut = cut_text if self._separable else lambda text: [text] if text else []
        self._starts = np.array([p.piece.startswith(_SPACE) for p in model.pieces])
        self._many = getattr(self.backend, "encode_batch_fast", self.backend.encode_batch)
        self.differing: set[str] = set()
        self._cache = PieceCache(np.int32)

    def _ours(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._many(texts, add_special_tokens=False)]

    def _theirs(self, texts: list[str]) -> list[list[int]]:
        return self._reference.encode(texts, num_threads=1)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the backend, and by the library where the two differ; plain words go many to a text."""
        plain = [self._separable and p != "" and " " not in p for p in pieces]
        if all(plain):
            ours, counts = encode_words(pieces, self._ours, self._starts, False, np.int32)
            theirs, expected = encode_words(pieces, self._theirs, self._starts, False, np.int32)
        else:
            ours, counts = flatten(self._ours(pieces), np.int32)
            theirs, expected = flatten(self._theirs(pieces), np.int32)
        if not (np.array_equal(counts, expected) and np.array_equal(ours, theirs)):
            a, b = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((ours, counts), (theirs, expected)))
            wrong = [not np.array_equal(x, y) for x, y in zip(a, b)]
            self.differing.update(p for p, w in zip(pieces, wrong) if w)
            mended = [y if w else x for x, y, w in zip(a, b, wrong)]
            return np.concatenate(mended), np.array(list(map(len, mended)), counts.dtype)
        return ours, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """All ids, the number per text, and whether each text has parity."""
        pieces = [self._cut(t) for t in texts]
        ids, counts = self._cache.ids(pieces, self._encode)
        return ids, counts, [not self.differing or self.differing.isdisjoint(p) for p in pieces]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.backend.decode_batch(ids, skip_special_tokens=False)


_COLUMNS = {"ids": "array<int>", "n_tokens": "long", "ids_crc32": "long", "parity": "boolean", "decoded_equal": "boolean"}


def encode_documents(df: DataFrame, model_path: str, outputs=tuple(_COLUMNS), text_col: str = "text") -> DataFrame:
    """``df`` with the wanted of: ``ids``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    32-bit numbers), ``parity`` and ``decoded_equal`` (decoding the ids gives the text again)."""
    kind = ", ".join(f"{name}: {_COLUMNS[name]}" for name in outputs)

    @F.arrow_udf(f"struct<{kind}>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model_path)
        for batch in batches:
            parts = []
            for _, _, texts in text_slices(batch, BLOCK):
                ids, counts, parity = codec.encode(texts)
                ends = np.cumsum(counts)
                made = {"n_tokens": pa.array(counts, pa.int64()), "parity": pa.array(parity, pa.bool_())}
                if "ids" in outputs:
                    made["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                spans = [ids[e - n:e] for e, n in zip(ends, counts)]
                if "ids_crc32" in outputs:
                    made["ids_crc32"] = pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64())
                if "decoded_equal" in outputs:
                    back = codec.decode([s.tolist() for s in spans])
                    made["decoded_equal"] = pa.array([d == (t or "") for d, t in zip(back, texts)], pa.bool_())
                parts.append(pa.StructArray.from_arrays([made[name] for name in outputs], names=list(outputs)))
            yield pa.concat_arrays(parts)

    return (df.withColumn("_encoded", encoded(F.col(text_col)))
            .withColumns({name: F.col("_encoded")[name] for name in outputs}).drop("_encoded"))


def query_sentencepiece(spark, sf_dir: str, vocabulary: str = "piece_bpe_32k.model"):
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    wanted = ("n_tokens", "ids_crc32", "parity", "decoded_equal")
    return encode_documents(docs, public_tokenizers.path(vocabulary), wanted).drop("text")
