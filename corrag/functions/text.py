"""Token and text columns. A token is a maximal run of non-space characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

CHILD_TOKENS = 512
CHILD_OVERLAP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    A plain expression would be computed anew in every branch and in every step of a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of Unicode; ``\s`` alone is that of ASCII.
_WHITE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip_ws(text: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` only strips blanks)."""
    return F.regexp_replace(text, f"^{_WHITE}+|{_WHITE}+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """Tokens with the white space before them, so joined slices are exact substrings."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))


def count_tokens(text: Column, tokenizer: Tokenizer = tokens) -> Column:
    return F.size(tokenizer(text))


def truncate_tokens(text: Column, limit: int | Column, tokenizer: Tokenizer = spaced_tokens) -> Column:
    """``text`` unchanged when it has at most ``limit`` tokens, else its first ``limit``."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return let(tokenizer(text), lambda pieces: F.when(F.size(pieces) <= limit, text).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), limit), "")))


def split_tokens(
    text: Column,
    max_tokens: int = CHILD_TOKENS,
    overlap: int = CHILD_OVERLAP,
    tokenizer: Tokenizer = spaced_tokens,
) -> Column:
    """Overlapping windows of ``max_tokens``; the last one is the first to reach the end.

    A text without tokens yields itself as the only window.
    """
    step = max_tokens - overlap

    def windows(pieces: Column) -> Column:
        starts = F.sequence(
            F.lit(0), F.greatest(F.lit(0), F.size(pieces) - F.lit(overlap + 1)), F.lit(step))
        return F.when(F.size(pieces) == 0, F.array(text)).otherwise(F.transform(
            starts, lambda start: F.array_join(F.slice(pieces, start + 1, F.lit(max_tokens)), "")))

    return let(tokenizer(text), windows)


def split_counted(text: Column, max_tokens: int = CHILD_TOKENS, overlap: int = CHILD_OVERLAP) -> Column:
    """``text`` itself and then the windows of ``split_tokens``, as structs of ``text`` and ``n``, its number of tokens."""
    step = max_tokens - overlap

    def windows(pieces: Column) -> Column:
        starts = F.sequence(
            F.lit(0), F.greatest(F.lit(0), F.size(pieces) - F.lit(overlap + 1)), F.lit(step))
        whole = F.array(F.struct(text.alias("text"), F.size(pieces).alias("n")))
        return F.concat(whole, F.when(F.size(pieces) == 0, F.array(F.struct(text.alias("text"), F.lit(0).alias("n")))).otherwise(
            F.transform(starts, lambda start: F.struct(
                F.array_join(F.slice(pieces, start + 1, F.lit(max_tokens)), "").alias("text"),
                F.least(F.lit(max_tokens), F.size(pieces) - start).alias("n")))))

    return let(spaced_tokens(text), windows)


def words(text: Column) -> Column:
    """Lower-cased letter/digit runs: the terms of the sparse index, for both sides."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space; empty pieces dropped."""
    return F.filter(F.split(strip_ws(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def snippet(text: Column, length: int = 200) -> Column:
    """The first ``length`` characters, NULL when there is no text."""
    return F.when(F.length(text) > 0, F.substring(text, 1, length))
