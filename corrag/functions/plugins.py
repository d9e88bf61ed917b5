"""Adapters for models that a caller brings: plain Python over batches, run by Arrow.

An embedder is passed to ``operators.embedding.embed`` as it is. The adapters here turn a
scorer or tokenizer into a column function for ``rerank``, ``chunk_blocks``, ``build_context``
and ``trim_history``. Verdicts of a model are joined as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrag.operators.batches import BYTES_AT_ONCE, by_slices, text_sizes


def batch_scorer(score: Callable[[Sequence[str], Sequence[str]], Sequence[float]]) -> Callable[[Column, Column], Column]:
    """``score(queries, texts)`` for a batch of pairs, as a scorer for ``rerank``."""
    @F.pandas_udf(T.DoubleType())
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([float(s) for s in score(query.tolist(), text.tolist())])

    return run


def batch_tokenizer(tokenize: Callable[[Sequence[str]], Sequence[Sequence[str]]]) -> Callable[[Column], Column]:
    """``tokenize(texts)`` for slices of a batch. Pieces that keep their white space can also serve as
    the splitter, since joined pieces then give the text back."""
    kind = pa.list_(pa.string())

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([list(pieces) for pieces in tokenize(texts.to_pylist())], kind)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(text: pa.Array) -> pa.Array:
        known = text.fill_null("")
        return by_slices(known, text_sizes(known), BYTES_AT_ONCE, cut)

    return run


def with_verdicts(df: DataFrame, verdicts: DataFrame, column: str = "verdict", key: str = "query_id") -> DataFrame:
    """Add a model's replies; rows without one get NULL."""
    return df.join(verdicts.select(key, column), key, "left")
