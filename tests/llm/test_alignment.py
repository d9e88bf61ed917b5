import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corrag.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokens():
    """``plain_tokens(text)``: (id, bytes) lists of both whole-text encodings."""
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    spelled = alignment.byte_level_side(FIRST).spelled
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda text: ([(i, spelled[i]) for i in a.encode(" " + text, add_special_tokens=False).ids],
                         [(i, piece(i)) for i in b.encode(text)])


def plain(texts, tokens):
    """Everything token by token."""
    rows, counts = [], Counter()
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in spans))
            start = end
        linked = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        counts.update(set(linked))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), linked, digest))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, n_groups, len(linked), sum(counts[p] == best[p[0]] for p in linked), sum(counts[p] for p in linked), digest)
            for n_a, n_b, n_groups, linked, digest in rows]


def odd_texts(prose, n=150, seed=1):
    rng = random.Random(seed)
    bits = ["the ", "naïve", " ", "  ", "\n", " \n", "\t", "don't", "1234567", "…", "日本語", "🙂", "<|endoftext|>", "<s>", "​", "　",
            "\x1c", "é", "x" * 30, "\r\n", ".", ",", "ñ", " ", "ß", " a", "b "]
    return [prose(20, 5), prose(300, 6), " lead", "trail ", "  ", "\n", "▁", "a▁b", "a \n b", "a\n \nb", "x  y   z", "foo \tbar"] + [
        "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_equals_token_by_token(spark, documents, prose, table_folder, plain_tokens):
    texts = odd_texts(prose) + [None, "", "same text here", "same text here"]
    want = plain(texts, plain_tokens)
    got = alignment.query_alignment(spark, table_folder(documents=documents(texts, block=["x"] * len(texts), id=["y"] * len(texts))))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(got) == sorted((i, *w) for i, w in enumerate(want))
    assert want[6][0] == 0 and want[0][0] > 0


def test_pieces_and_parts_change_nothing(prose, plain_tokens, monkeypatch):
    encoder = alignment.Encoder(alignment.byte_level_side(FIRST), alignment.piece_side(SECOND))
    texts = odd_texts(prose, 400, 2)
    for text in texts:
        a, b = encoder.ids([alignment.text_pieces(text)])
        x, y = plain_tokens(text)
        raw = (" " + text).encode()
        if b"".join(s for _, s in x) == raw == b"".join(s for _, s in y):
            assert np.frombuffer(a[0], np.uint16).tolist() == [i for i, _ in x] and np.frombuffer(b[0], np.uint16).tolist() == [i for i, _ in y]
        else:
            assert not a[0] and not b[0]
    long = prose(400, 3) + "\n" + prose(200, 4)
    whole = alignment.align_texts([long], encoder)
    for name, value in {"BLOCK": 300, "REMEMBERED": 100, "LONG_PIECE": 5}.items():
        monkeypatch.setattr(alignment, name, value)
    parts = alignment.align_texts([long], encoder)
    assert [int(x[0]) for x in whole[0]] == [int(x[0]) for x in parts[0]] and whole[1] == parts[1]
    assert all(np.array_equal(x, y) for x, y in zip(whole[2:], parts[2:]))
    assert alignment.align_texts([long + "▁"], encoder)[1] == [""]


def test_groups_end_at_shared_ends():
    rng = np.random.default_rng(4)
    for share in (0.02, 0.3, 0.9):
        offsets = np.arange(1, 3000)
        both = rng.random(len(offsets)) < share
        a = offsets[both | (rng.random(len(offsets)) < 0.3)]
        b = offsets[both | (rng.random(len(offsets)) < 0.3)]
        a, b = (np.unique(np.append(x, 3000)) for x in (a, b))
        want = np.flatnonzero(np.isin(a, b))
        assert np.array_equal(alignment.shared_groups(a, b, np.array([len(a) - 1])), want)


def test_empty_and_repeated(spark, documents, table_folder, tmp_path):
    assert alignment.query_alignment(spark, table_folder(documents=documents([]))).count() == 0
    docs = documents(["one two", None, "one two"], ids=[3, 3, None])
    encoder = lambda: alignment.Encoder(alignment.byte_level_side(FIRST), alignment.piece_side(SECOND))
    rows = alignment.align_documents(docs, encoder).collect()
    assert sorted(r.count_sum for r in rows) == [0, 4, 4] and len(rows) == 3
