"""A block of query terms that travels to the workers, scored against batches of sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corrag.operators.batches import CELLS_AT_ONCE, WORDS_AT_ONCE, list_lengths, slices
from corrag.operators.blockmatch import SCORE_DIGITS

# Terms of queries that travel to the workers at once.
TERM_BLOCK = 200_000


@dataclass(frozen=True)
class TermBlock:
    """The entries of queries by term: those of ``vocabulary[i]`` lie at ``start_of[i]:start_of[i + 1]``."""

    vocabulary: pa.Array
    start_of: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    query_ids: list
    scopes: dict


def term_block(entries: pa.Table) -> TermBlock:
    """The block of ``query_id, term, weight`` and maybe ``scope``."""
    entries = entries.sort_by("term").combine_chunks()
    asked = entries.column("query_id").to_pylist()
    query_ids = list(dict.fromkeys(asked))
    place = {query: i for i, query in enumerate(query_ids)}
    vocabulary = entries.column("term").unique()
    term_of = pc.index_in(entries.column("term"), vocabulary).to_numpy()
    scopes = dict(zip(asked, entries.column("scope").to_pylist())) if "scope" in entries.column_names else {}
    return TermBlock(
        vocabulary, np.searchsorted(term_of, np.arange(len(vocabulary) + 1)),
        np.array([place[q] for q in asked], dtype=np.int64), entries.column("weight").to_numpy(),
        query_ids, {place[q]: scope for q, scope in scopes.items() if scope is not None})


def scored_parts(block: TermBlock, records: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Slices of ``records`` with the ``(chunk_id, paper_id)`` of their rows and the scores, queries x rows;
    ``-inf`` is no hit. A slice holds about ``CELLS_AT_ONCE`` scores and matches of a term with a query."""
    fan_of = np.diff(block.start_of)
    for begin, end in slices(list_lengths(records.column("terms")), WORDS_AT_ONCE):
        some = records.slice(begin, end - begin)
        terms = some.column("terms")
        term = pc.index_in(terms.flatten(), block.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        known = term >= 0
        row = np.repeat(np.arange(len(some)), list_lengths(terms))[known]
        weight = some.column("weights").flatten().to_numpy(zero_copy_only=False)[known]
        term = term[known]
        # Every stored term meets each query that has it.
        fan = fan_of[term]
        met = np.bincount(row, fan, len(some)).astype(np.int64)
        for first, last in slices(met + len(block.query_ids), CELLS_AT_ONCE):
            low, high = np.searchsorted(row, (first, last))
            wide, part = fan[low:high], some.slice(first, last - first)
            entry = np.arange(wide.sum()) + np.repeat(block.start_of[term[low:high]] - (np.cumsum(wide) - wide), wide)
            cell = block.query[entry] * len(part) + np.repeat(row[low:high] - first, wide)
            scores = np.bincount(cell, np.repeat(weight[low:high], wide) * block.weight[entry],
                                 len(block.query_ids) * len(part)).reshape(len(block.query_ids), len(part))
            scores = np.round(scores.astype(np.float64), SCORE_DIGITS)
            scores[scores <= 0] = -np.inf
            ids = list(zip(*(part.column(c).to_pylist() for c in ("chunk_id", "paper_id"))))
            for query, scope in block.scopes.items():
                scores[query, [str(paper) != scope for _, paper in ids]] = -np.inf
            yield part, ids, scores
