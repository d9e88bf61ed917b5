"""Schemas of the engine's own tables. Nothing of ours is read with inference."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())
VECTOR = T.ArrayType(T.FloatType())

PAGES = _struct(paper_id=STRING, html=STRING)

PAPERS = _struct(
    paper_id=STRING, title=STRING, abstract=STRING, authors=T.ArrayType(STRING),
    published_date=STRING, ingestion_status=STRING,
    created_at=T.TimestampType(), updated_at=T.TimestampType())

BLOCKS = _struct(
    paper_id=STRING, block_idx=INT, section_name=STRING, text=STRING,
    content_type=STRING, media_url=STRING)

LINES = _struct(
    paper_id=STRING, page=INT, line_no=INT, text=STRING, max_font=DOUBLE, is_bold=BOOL,
    y0=DOUBLE, y1=DOUBLE, in_table=BOOL)

CHUNKS = _struct(
    chunk_id=STRING, paper_id=STRING, chunk_type=STRING, content_type=STRING, media_url=STRING,
    section_name=STRING, text=STRING, parent_chunk_id=STRING, token_count=INT)

VECTORS = _struct(
    chunk_id=STRING, paper_id=STRING, section_name=STRING, chunk_type=STRING,
    content_type=STRING, dense_vector=VECTOR)

POSTINGS = _struct(term=STRING, chunk_id=STRING, paper_id=STRING, weight=DOUBLE)

TERM_COUNTS = _struct(
    chunk_id=STRING, paper_id=STRING, length=INT, terms=T.ArrayType(STRING), tfs=T.ArrayType(INT))

STORED_PAPERS = _struct(
    paper_id=STRING, title=STRING, abstract=STRING, published_date=STRING, ingestion_status=STRING)

QUERIES = _struct(
    query_id=STRING, mode=STRING, paper_id=STRING, user_message=STRING,
    query_vector=VECTOR, retry_count=INT)

HITS = _struct(query_id=STRING, chunk_id=STRING, paper_id=STRING, score=DOUBLE, rank=INT)

QRELS = _struct(query_id=STRING, chunk_id=STRING, relevance=INT)
RUNS = _struct(run_name=STRING, query_id=STRING, chunk_id=STRING, score=DOUBLE)
SCORES = _struct(paper_id=STRING, metric=STRING, value=DOUBLE)

SESSIONS = _struct(
    session_id=STRING, client_id=STRING, mode=STRING, paper_id=STRING, title=STRING,
    created_at=T.TimestampType())
MESSAGES = _struct(session_id=STRING, turn=LONG, role=STRING, content=STRING)

TURN_EVENTS = _struct(
    session_id=STRING, turn_id=LONG, seq=LONG, ts=T.TimestampType(), type=STRING,
    content=STRING, arxiv_id=STRING, title=STRING, abstract_snippet=STRING)

REQUESTS = _struct(client_id=STRING, route=STRING, ts=T.TimestampType())

QA_JSON = "array<struct<question:string,answer:string,contexts:array<string>>>"
QRELS_JSON = "array<struct<query:string,relevant_chunk_ids:array<string>>>"
