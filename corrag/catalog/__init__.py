"""Registered queries over the test tables, each with its SQL counterpart where one exists."""

from corrag.catalog.registry import ORACLES, QUERIES  # noqa: F401
from corrag.catalog import (  # noqa: F401
    dialogue, evaluation, ingest, plugins, retrieval, streams)
