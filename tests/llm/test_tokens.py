import zlib

import numpy as np
import public_tokenizers
import pytest

from corrag.llm import sentencepieces, tokenfiles
from corrag.session import new_shared_path

ODD = [None, "", " ", "Hello, World. it's e.g. 3.5%", "tab\tand\nline  two   spaces ", "naïve ÉCOLE ß İ Σας", "漢字 かな 😀👍🏽", "\x1cctl\x1d x y z",
       "a" * 3000, "é ́x", "▁ meta ▁▁ marks", "<s> </s> <|endoftext|> <unk>", "'s 't don't. we'll,", "mixed9numbers12,x., ..", "​zero﻿"]


@pytest.fixture
def texts(prose):
    return ODD + [prose(300, i) for i in range(8)] + [prose(300, 3)] + [prose(9000, 20)]


def test_files_hold_what_the_tokenizer_gives(spark, documents, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    folder = new_shared_path(spark, "test-tokens")
    manifest = tokenfiles.encode_to_files(documents(texts), folder, path, 2)
    found = {r.doc_id: r for r in tokenfiles.read_documents(manifest, folder).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (found[i].start, found[i].n_tokens) == (start, len(ids)), text
        assert found[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_sequences_have_equal_length_and_masks(spark, documents, prose):
    folder = new_shared_path(spark, "test-tokens")
    docs = documents([prose(400, i) for i in range(6)])
    rows = tokenfiles.encode_to_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    system, root = tokenfiles.open_filesystem(folder)
    for name in {r.file for r in rows}:
        file = tokenfiles.TokenFile(system, f"{root}/{name}")
        total = sum(r.n_tokens for r in rows if r.file == name)
        real = 0
        for i in range(-(-total // tokenfiles.LENGTH)):
            assert len(file.sequence(i)) == len(file.mask(i)) == tokenfiles.LENGTH
            real += int(file.mask(i).sum())
        assert real == total and file.span(total - 1, 1)[0] == 2


def test_token_files_of_an_empty_table(spark, documents):
    folder = new_shared_path(spark, "test-tokens")
    manifest = tokenfiles.encode_to_files(documents([]), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert tokenfiles.read_documents(manifest, folder).count() == 0


def test_sentencepiece_ids_parity_and_decoding(spark, documents, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(texts, ids_crc32=["x"] * len(texts), parity=["y"] * len(texts))
    for r in sentencepieces.encode_documents(docs, path).collect():
        ids = plain.encode(texts[r.doc_id] or "")
        assert (r.ids, r.n_tokens) == (ids, len(ids)), texts[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.parity
        assert r.decoded_equal == ("▁" not in (texts[r.doc_id] or "")), texts[r.doc_id]


def test_sentencepiece_of_an_empty_table(spark, documents):
    assert sentencepieces.encode_documents(documents([]), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_ids_come_from_the_backend_and_from_the_library_on_a_difference(monkeypatch):
    import numpy as np
    import public_tokenizers

    from corrag.llm import sentencepieces

    codec, made = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model")), []
    monkeypatch.setattr(sentencepieces, "encode_words", lambda *a: made.append(encode_words(*a)) or made[-1])
    encode_words = __import__("corrag.llm.wordcache", fromlist=["encode_words"]).encode_words
    ids, _ = codec._encode(["some", "words"])
    assert ids is made[0][0] and not codec.differing  # the first call is the backend's
    right, counts = codec._encode(["some  x", "words"])
    ours = codec._ours
    monkeypatch.setattr(codec, "_ours", lambda texts: [[1] if t == "words" else i for t, i in zip(texts, ours(texts))])
    ids, n = codec._encode(["some  x", "words"])
    assert np.array_equal(ids, right) and np.array_equal(n, counts) and codec.differing == {"words"}


def test_word_encoder_equals_the_tokenizer_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), tokenfiles.WordEncoder(path)
    rng = np.random.default_rng(5)
    parts = ["a", "Zq", "é", "é", "Σ", "ς", "ß", "İ", ".", ",", "%%%", "'", "s", "'t", "_", "<|endoftext|>", "<|", "|>", "7", "漢字",
             " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "😀", "̸", "<", "\0"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(3000)] + [None, ""]
    for block in (texts, [t for t in texts if "\x1c" not in (t or "")]):  # two ways to cut words
        flat, counts = encoder.ids(pa.array(block, pa.string()))
        got = np.split(flat, np.cumsum(counts)[:-1])
        for text, ids in zip(block, got):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_texts_without_spaces_leave_nothing_in_the_cache():
    import pyarrow as pa

    from corrag.llm import wordcache

    encoder = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    long = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 2000))) for _ in range(800)]  # 5 MB of UTF-8
    before, _ = encoder.ids(pa.array(["known words"]))
    encoder.ids(pa.array(long))
    cache = encoder._cache
    assert all(len(piece) <= wordcache.LONG for piece in cache._place) and cache._chars < 100
    assert len(cache._lengths) == len(cache._place) and len(cache._flat) == cache._lengths.sum() < 100
    assert encoder.ids(pa.array(["known words"]))[0].tolist() == before.tolist()
