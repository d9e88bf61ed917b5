"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

from corrag.llm.common import mix

#: Bytes that one numpy block holds.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int):
    """The powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(20, int(n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array that ends with white space."""
    gap = _GAP[data]
    before = np.concatenate(([True], gap[:-1]))
    return np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: a polynomial by prefix sums, then a finaliser."""
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_words(texts: list[bytes]):
    """(data, starts, ends, hashes, counts): the words of the texts, joined, and how many each has."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(data)
    text_ends = np.cumsum(lengths)
    until = np.searchsorted(starts, text_ends)
    return data, starts, ends, word_hashes(data, starts, ends), np.diff(until, prepend=0)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on; for the last ``size - 1`` of them there is none."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + words[k:k + n])
    return h


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, one hash of all of them."""
    _, _, _, words, counts = text_words([lower_bytes(t) for t in texts])
    all_of_them = shingle_hashes(words, size)
    sets, at = [], 0
    for n in counts:
        if n >= size:
            sets.append(np.unique(all_of_them[at:at + n - size + 1]))
        elif n:
            short = shingle_hashes(words[at:at + n], int(n))
            sets.append(mix(short + np.uint64(int(n))))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets
