"""Token ids of texts from the ids of their pieces: each distinct piece is encoded once per task.

For tokenizers whose result for a text is the joined result for its pieces. The pieces of a batch
are looked up in a dictionary; only new ones go to the tokenizer. The dictionary is dropped when it
holds ``LIMIT`` pieces or ``LIMIT_CHARS`` characters, and pieces longer than ``LONG`` are not kept beyond
the call, which bounds memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

LIMIT = 400_000
LIMIT_CHARS = 1 << 23
LONG = 256
#: Plain words that go to the tokenizer as one text.
JOINED = 64


def flatten(lists: Sequence[Sequence[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of each list."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype, int(counts.sum())), counts


def taken(flat: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at these places, given and returned as all their values and their lengths."""
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).take(pa.array(at))
    return lists.flatten().to_numpy(), counts[at]


def encode_words(words: list[str], encode: Callable, marks: np.ndarray, marks_end: bool, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of words that a tokenizer never joins, many words to a text.

    Exactly one id of every word is in ``marks``, its last or its first one; so the ids of a text can
    be cut into words. A text with another number of marks is encoded word by word.
    """
    groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
    flat, lengths = [], []
    for group, ids in zip(groups, encode([" ".join(g) for g in groups])):
        ids = np.array(ids, dtype)
        at = np.flatnonzero(marks[ids])
        if len(at) != len(group):
            ids, counts = flatten(encode(group), dtype)
        elif marks_end:
            counts = np.diff(at, prepend=-1)
        else:
            counts = np.diff(np.append(at, len(ids)))
        flat.append(ids)
        lengths.append(counts)
    return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.empty(0, dtype), np.empty(0, np.int64))


class PieceCache:
    """``encode``, given with each call, maps a list of pieces to all their ids and the number of each.

    The cache does not keep it, so that no circle of references outlives a task with its tables.
    """

    def __init__(self, dtype):
        self._dtype = dtype
        self._clear()

    def _clear(self):
        self._place: dict[str, int] = {}
        self._flat, self._lengths, self._chars = np.empty(0, self._dtype), np.empty(0, np.int64), 0

    def lookup(self, pieces: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and the number of ids per piece."""
        if len(self._place) > LIMIT or self._chars > LIMIT_CHARS:
            self._clear()
        place, kept = self._place, len(self._place)
        new = [piece for piece in dict.fromkeys(pieces) if piece not in place]
        new.sort(key=lambda piece: len(piece) > LONG)  # long ones last: they go again
        flat, lengths = self._flat, self._lengths
        if new:
            more, counts = encode(new)
            place.update(zip(new, range(kept, kept + len(new))))
            flat, lengths = np.concatenate((flat, more.astype(self._dtype))), np.concatenate((lengths, counts))
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        short = len(new)
        while short and len(new[short - 1]) > LONG:
            short -= 1
            del place[new[short]]
        self._chars += sum(map(len, new[:short]))
        self._lengths = lengths[:kept + short]
        self._flat = flat[:int(self._lengths.sum())]
        if short < len(new):
            self._flat = self._flat.copy()  # lets go of the ids of long pieces
        return taken(flat, lengths, at)

    def ids(self, texts: list[list[str]], encode: Callable) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each given as its pieces, and the number of ids per text."""
        flat, per_piece = self.lookup(list(chain.from_iterable(texts)), encode)
        before = np.concatenate(([0], np.cumsum(per_piece)))
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        return flat, np.diff(before[text_ends], prepend=0)
