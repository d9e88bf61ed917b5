"""Search, reranking, selection and suggestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag.catalog import sqltext as sql
from corrag.catalog import tables
from corrag.catalog.registry import query
from corrag.functions.vectors import cosine, dot, l2_norm, l2_normalize
from corrag.operators.embedding import embed, hash_vector
from corrag.operators.impacts import impact_report, impact_search, open_impacts, write_impacts
from corrag.operators.postings import (
    postings, sparse_encode_documents, sparse_encode_queries, stage_term_counts, term_statistics)
from corrag.operators.search import (
    ann_dense_search, ann_index, ann_recall, dense_search, enrich_hits, hybrid_search,
    query_scope, rrf_fuse, sparse_search)
from corrag.operators.selection import (
    attach_vectors, expand_parents, mmr_select, rerank, select_candidates, suggest_papers)
from corrag.operators.topk import top_k
from corrag.plans.answer import gather_evidence, prepare_queries, summarize
from corrag.plans.corpus import Settings, build_corpus, open_corpus
from corrag.plans.correct import build_reserve, corrective_search, search_reserve
from corrag.plans.ingest import ingest_blocks_to_store
from corrag.session import new_shared_path, staged

DIM = 64
_PASSAGES = ("children", "chunk_id", "paper_id", "text")


def _sparse(chunks: DataFrame, avg_len: float | None = None) -> DataFrame:
    return sparse_encode_documents(chunks, avg_len=avg_len, counts=stage_term_counts(chunks))


# --- Sparse search ------------------------------------------------------------------------

def _bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(spark, sf).select(F.col("paper_id").alias("chunk_id"), "paper_id", "text")


_DOCS = ("papers", "paper_id", "paper_id", "text")


def stored_impacts(spark: SparkSession, vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """The vectors' impact index, written and opened again for these query terms."""
    path = new_shared_path(spark, "impacts")
    write_impacts(vectors, path, buckets=16)
    return open_impacts(spark, path, terms, buckets=16)


def _bm25(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _bm25_documents(spark, sf)
    counts = stage_term_counts(docs)
    terms = staged(sparse_encode_queries(
        tables.questions(spark, sf), term_statistics(counts), docs.agg(F.count("*")).scalar()), "terms")
    vectors = staged(sparse_encode_documents(docs, counts=counts), "sparse")
    return terms, stored_impacts(spark, vectors, terms), vectors


@query("bm25_topk", f"""WITH {sql.PAPERS}, {sql.bm25(*_DOCS, idf=True)}, {sql.ranked("sparse", "top", 10)}
SELECT query_id, chunk_id, score, rank FROM top""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents by the stored impact index."""
    return impact_search(*_bm25(spark, sf), 10).select("query_id", "chunk_id", "score", "rank")


# The same postings in blocks by weight, and what a search with a floor has to open.
_IMPACTS = f"""{sql.bm25(*_DOCS, idf=True)},
placed AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, chunk_id) AS place FROM postings),
blocked AS (SELECT *, CASE WHEN place <= 64 THEN 0 WHEN place <= 8192 THEN CAST(ceil(log2(place / 64.0)) AS INTEGER)
                           ELSE 8 + (place - 8193) // 4096 END AS block FROM placed),
blocks AS (SELECT term, block, max(weight) AS most, count(*) AS n FROM blocked GROUP BY ALL),
reach AS (SELECT query_id, term, qw, qw * most AS top FROM query_terms JOIN blocks USING (term) WHERE block = 0),
heads AS (SELECT query_id, chunk_id, round(sum(qw * weight), 6) AS score
          FROM query_terms JOIN blocked USING (term) WHERE block = 0 GROUP BY ALL),
tried AS (SELECT query_id, chunk_id FROM heads QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10),
floors AS (SELECT query_id, min(score) AS floor FROM tried JOIN sparse USING (query_id, chunk_id) GROUP BY query_id HAVING count(*) = 10),
ordered AS (SELECT *, sum(top) OVER (PARTITION BY query_id ORDER BY top, term ROWS UNBOUNDED PRECEDING) AS upto,
                   sum(top) OVER (PARTITION BY query_id) AS total FROM reach),
cells AS (SELECT query_id, n, floor IS NULL OR (upto >= floor - 2e-6 AND total - top + qw * most >= floor - 2e-6) AS open
          FROM ordered LEFT JOIN floors USING (query_id) JOIN blocks USING (term))"""


@query("bm25_opened", f"""WITH {sql.PAPERS}, {_IMPACTS}
SELECT query_id, CAST(sum(n) AS BIGINT) AS postings, CAST(coalesce(sum(n) FILTER (WHERE open), 0) AS BIGINT) AS opened,
       count(*) AS blocks, count(*) FILTER (WHERE open) AS opened_blocks FROM cells GROUP BY query_id""")
def bm25_opened(spark: SparkSession, sf: str) -> DataFrame:
    """How many of its postings and blocks each question opens for its ten best documents."""
    return impact_report(*_bm25(spark, sf), 10)


@query("bm25_topk_noidf", f"""WITH {sql.children()}, {sql.bm25(*_PASSAGES, idf=False, avg_len="256")},
{sql.ranked("sparse", "top", 10)} SELECT query_id, chunk_id, score, rank FROM top""")
def bm25_topk_noidf(spark: SparkSession, sf: str) -> DataFrame:
    """Saturated term frequency only, over passages, with a fixed reference length."""
    children = tables.children(tables.documents(spark, sf))
    terms = sparse_encode_queries(tables.questions(spark, sf))
    return sparse_search(terms, _sparse(children, 256.0), 10).select(
        "query_id", "chunk_id", "score", "rank")


@query("sparse_index", f"""WITH {sql.children()}, {sql.bm25(*_PASSAGES, idf=False)}
SELECT term, count(*) AS doc_freq, round(sum(weight), 4) AS total_weight FROM postings GROUP BY term""")
def sparse_index(spark: SparkSession, sf: str) -> DataFrame:
    """The weighted postings of all passages, summed up per term."""
    entries = postings(_sparse(tables.children(tables.documents(spark, sf))))
    return entries.groupBy("term").agg(
        F.count("*").alias("doc_freq"), F.round(F.sum("weight"), 4).alias("total_weight"))


# --- Dense search -------------------------------------------------------------------------

_PROTOTYPES = """protos AS (
  SELECT CAST(label AS VARCHAR) AS query_id, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS q
  FROM embeddings, range(64) r(i) GROUP BY ALL),
pn AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM protos GROUP BY query_id),
cells AS (SELECT vec_id AS chunk_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v
          FROM embeddings, range(64) r(i)),
cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM cells GROUP BY chunk_id),
dense AS (
  SELECT query_id, chunk_id, round(sum(q * v) / (any_value(pn.n) * any_value(cn.n)), 6) AS score
  FROM protos JOIN cells USING (i) JOIN pn USING (query_id) JOIN cn USING (chunk_id)
  GROUP BY query_id, chunk_id)"""


def _prototypes(vectors: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors."""
    cells = vectors.select("paper_id", F.posexplode("dense_vector").alias("i", "v"))
    means = cells.groupBy("paper_id", "i").agg(F.avg(F.col("v").cast("double")).alias("q"))
    return means.groupBy(F.col("paper_id").alias("query_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "q"))), lambda c: c["q"]).alias("query_vector"))


@query("dense_topk", f"""WITH {_PROTOTYPES}, {sql.ranked("dense", "top", 20)}
SELECT query_id, chunk_id, score, rank FROM top""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest stored vectors to the mean vector of every label."""
    vectors = tables.embeddings(spark, sf)
    return dense_search(_prototypes(vectors), vectors, 20).select("query_id", "chunk_id", "score", "rank")


@query("dense_single_label", f"""WITH {_PROTOTYPES},
own AS (SELECT d.* FROM dense d JOIN embeddings e ON d.chunk_id = e.vec_id
        WHERE d.query_id = CAST(e.label AS VARCHAR)),
{sql.ranked("own", "top", 20)} SELECT query_id, chunk_id, score, rank FROM top""")
def dense_single_label(spark: SparkSession, sf: str) -> DataFrame:
    """The same search where each query may only see the vectors of its own label."""
    vectors = tables.embeddings(spark, sf)
    scoped = _prototypes(vectors).withColumn("scope", F.col("query_id"))
    return dense_search(scoped, vectors, 20).select("query_id", "chunk_id", "score", "rank")


@query("vector_functions", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
unit AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS u FROM v)
SELECT x.vec_id, round(list_inner_product(x.a, y.a), 5) AS dot, round(list_cosine_similarity(x.a, y.a), 5) AS cosine,
       round(sqrt(list_inner_product(x.a, x.a)), 5) AS norm, round(u[1], 5) AS first_unit, round(list_inner_product(u, u), 5) AS unit_norm
FROM v x JOIN v y ON y.vec_id = x.vec_id + 1 JOIN unit ON unit.vec_id = x.vec_id""")
def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the next one: dot product, cosine, norm, and the vector at unit length."""
    stored = tables.embeddings(spark, sf).select(F.col("chunk_id").alias("vec_id"), F.col("dense_vector").alias("a"))
    following = stored.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    unit = l2_normalize(F.col("a"))
    return stored.join(following, "vec_id").select(
        "vec_id", F.round(dot(F.col("a"), F.col("b")), 5).alias("dot"), F.round(cosine(F.col("a"), F.col("b")), 5).alias("cosine"),
        F.round(l2_norm(F.col("a")), 5).alias("norm"), F.round(F.get(unit, F.lit(0)), 5).alias("first_unit"),
        F.round(dot(unit, unit), 5).alias("unit_norm"))


@query("ann_recall")
def ann_recall_query(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search against exact search for the label prototypes."""
    vectors = tables.embeddings(spark, sf)
    prototypes = staged(_prototypes(vectors), "prototypes")
    index = ann_index(vectors, 64)
    return ann_recall(dense_search(prototypes, vectors, 20), ann_dense_search(prototypes, index, 64, 20))


@query("hash_embed", f"""WITH {sql.PAPERS}, {sql.hash_vectors("vec", "papers", "paper_id", "text", DIM)}
SELECT id AS paper_id, CAST(bucket AS INTEGER) AS bucket, round(v, 5) AS value FROM vec WHERE v <> 0""")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf)
    return embed(docs.select("paper_id", "text"), "text", dim=DIM).select(
        "paper_id", F.posexplode_outer("dense_vector").alias("bucket", "_v")).filter(F.col("_v") != 0).select(
        "paper_id", "bucket", F.round(F.col("_v").cast("double"), 5).alias("value"))


# --- Hybrid search and what follows -------------------------------------------------------

_LIMIT = 30

_DENSE_LEG = f"""{sql.hash_vectors("dv", "children", "chunk_id", "text", DIM)},
{sql.hash_vectors("qv", "benchmark", "CAST(item_id AS VARCHAR)", "text", DIM)},
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id),
qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id),
dots AS (SELECT qv.id AS query_id, dv.id AS chunk_id, sum(qv.v * dv.v) AS dot
         FROM qv JOIN dv USING (bucket) GROUP BY ALL),
all_pairs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, chunk_id, paper_id
              FROM benchmark, children),
dense AS (
  SELECT p.query_id, p.chunk_id, p.paper_id,
         round(coalesce(CASE WHEN qn.n > 0 AND dn.n > 0 THEN d.dot / (qn.n * dn.n) END, 0), 6) + 0.0::DOUBLE AS score
  FROM all_pairs p LEFT JOIN dots d USING (query_id, chunk_id)
  LEFT JOIN qn ON qn.id = p.query_id LEFT JOIN dn ON dn.id = p.chunk_id)"""


def _fused(dense: str = "dense_top", sparse: str = "sparse_top") -> str:
    return f"""fused AS (
  SELECT query_id, chunk_id, paper_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
    SELECT query_id, chunk_id, paper_id, rank FROM {dense}
    UNION ALL SELECT query_id, chunk_id, paper_id, rank FROM {sparse}) GROUP BY ALL)"""


_HYBRID = f"""{sql.children(filtered=True)}, {_DENSE_LEG}, {sql.bm25(*_PASSAGES, idf=True)},
{sql.ranked("dense", "dense_top", 2 * _LIMIT)}, {sql.ranked("sparse", "sparse_top", 2 * _LIMIT)},
{_fused()}, {sql.ranked("fused", "hits", _LIMIT)}"""

_RERANKED = rf"""{_HYBRID},
q_terms AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct({sql.words("text")}) AS terms FROM benchmark),
rescored AS (
  SELECT h.query_id, h.chunk_id, h.paper_id, c.parent_chunk_id, c.text,
         round(CASE WHEN len(q.terms) = 0 THEN 0
               ELSE len(list_intersect(q.terms, {sql.words("c.text")})) / len(q.terms)::DOUBLE END, 6) AS score
  FROM hits h JOIN children c USING (chunk_id) JOIN q_terms q USING (query_id)
  WHERE {sql.strip("c.text")} <> ''),
{sql.ranked("rescored", "reranked", 12)}"""


def _mmr_steps(pool: str, steps: int = 5, lambda_: float = 0.7) -> str:
    """Greedy selection unrolled: each step picks the best remaining candidate per query."""
    out = f"""pool AS MATERIALIZED (SELECT * FROM {pool}),
pool_vectors AS MATERIALIZED (SELECT * FROM dv WHERE id IN (SELECT chunk_id FROM pool)),
pool_norms AS MATERIALIZED (SELECT id, sqrt(sum(v * v)) AS n FROM pool_vectors GROUP BY id),
sims AS MATERIALIZED (
  SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b,
         CASE WHEN any_value(na.n * nb.n) > 0 THEN sum(x.v * y.v) / any_value(na.n * nb.n) ELSE 0 END AS sim
  FROM pool a JOIN pool b USING (query_id)
  JOIN pool_vectors x ON x.id = a.chunk_id
  JOIN pool_vectors y ON y.id = b.chunk_id AND y.bucket = x.bucket
  JOIN pool_norms na ON na.id = a.chunk_id JOIN pool_norms nb ON nb.id = b.chunk_id
  GROUP BY ALL),
pick0 AS (SELECT query_id, chunk_id, 0 AS step FROM pool WHERE FALSE)"""
    for step in range(1, steps + 1):
        out += f""",
pick{step} AS MATERIALIZED (
  SELECT * FROM pick{step - 1} UNION ALL
  SELECT query_id, chunk_id, {step} AS step FROM (
    SELECT p.query_id, p.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY
      round({lambda_}::DOUBLE * p.score - {1 - lambda_}::DOUBLE * coalesce(
        (SELECT max(sim) FROM sims s JOIN pick{step - 1} k ON k.query_id = s.query_id AND k.chunk_id = s.b
         WHERE s.query_id = p.query_id AND s.a = p.chunk_id), 0), 9) DESC, p.rank) AS n
    FROM pool p WHERE NOT EXISTS (
      SELECT 1 FROM pick{step - 1} k WHERE k.query_id = p.query_id AND k.chunk_id = p.chunk_id)) WHERE n = 1)"""
    return out + f""",
selected AS (
  SELECT p.query_id, p.chunk_id, p.paper_id, p.parent_chunk_id, p.score, CAST(k.step AS INTEGER) AS rank
  FROM pick{steps} k JOIN pool p USING (query_id, chunk_id))"""


_SECTIONS = f"""wanted AS (
  SELECT query_id, parent_chunk_id, min(rank) AS best FROM selected GROUP BY ALL),
found AS (
  SELECT w.query_id, w.best, p.paper_id, p.paper_id || '#0' AS section_id, p.title, p.abstract,
         p.published_date, p.text
  FROM wanted w JOIN papers p ON w.parent_chunk_id = p.paper_id || '#0'),
{sql.ranked("found", "sections", 5, "best")}"""

_EVIDENCE = f"{sql.PAPERS}, {_RERANKED}, {_mmr_steps('reranked')}, {_SECTIONS}"


def _settings() -> Settings:
    return Settings(tables.CHUNK_TOKENS, tables.CHUNK_OVERLAP, DIM)


def corpus_of(spark: SparkSession, sf: str):
    docs = tables.documents(spark, sf)
    return build_corpus(tables.papers(docs), tables.blocks(docs), _settings())


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return embed(tables.questions(spark, sf), "user_message", dim=DIM, out="query_vector")


def _hits(spark: SparkSession, sf: str, corpus) -> DataFrame:
    return hybrid_search(questions(spark, sf), corpus.vectors, corpus.sparse, _LIMIT,
                         statistics=corpus.statistics, n_docs=corpus.n_docs)


@query("rrf_hybrid", f"WITH {_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, corpus_of(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("store_search", f"WITH {_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits")
def store_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a corpus that was ingested into a store and opened again."""
    docs, path = tables.documents(spark, sf), new_shared_path(spark, "search-store")
    ingest_blocks_to_store(spark, path, tables.papers(docs), tables.blocks(docs), _settings(), buckets=16)
    return _hits(spark, sf, open_corpus(spark, path, _settings())).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_OWN = f"""{sql.children()}, {_DENSE_LEG}, {sql.bm25(*_PASSAGES, idf=False, avg_len="256")},
best AS (SELECT query_id, min_by(paper_id, rank) AS own FROM (
  SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM sparse) WHERE rank = 1 GROUP BY query_id),
own_dense AS (SELECT d.* FROM dense d JOIN best b ON b.query_id = d.query_id AND b.own = d.paper_id),
own_sparse AS (SELECT d.* FROM sparse d JOIN best b ON b.query_id = d.query_id AND b.own = d.paper_id),
{sql.ranked("own_dense", "dense_top", 2 * _LIMIT)}, {sql.ranked("own_sparse", "sparse_top", 2 * _LIMIT)},
{_fused()}, {sql.ranked("fused", "hits", _LIMIT)}"""


@query("hybrid_single_paper", f"WITH {_OWN} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits")
def hybrid_single_paper(spark: SparkSession, sf: str) -> DataFrame:
    """Deep dives: every question is asked of the paper whose passage matches it best."""
    children = staged(tables.children(tables.documents(spark, sf)), "children")
    sparse = _sparse(children, 256.0)
    asked = questions(spark, sf)
    best = sparse_search(sparse_encode_queries(asked), sparse, 1).select("query_id", F.col("paper_id").alias("_own"))
    deep = staged(asked.join(best, "query_id").withColumn("mode", F.lit("deep_dive")).withColumn(
        "paper_id", F.col("_own")).drop("_own"), "deep")
    vectors = embed(children.select("chunk_id", "paper_id", "text"), "text", dim=DIM)
    return hybrid_search(deep, vectors, sparse, _LIMIT).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("dense_only_search", f"""WITH {sql.children()}, {_DENSE_LEG}, {sql.ranked("dense", "hits", _LIMIT)}
SELECT query_id, chunk_id, score, rank FROM hits""")
def dense_only_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = embed(tables.children(tables.documents(spark, sf)).select(
        "chunk_id", "paper_id", "text"), "text", dim=DIM)
    return hybrid_search(questions(spark, sf), vectors, None, _LIMIT, use_sparse=False).select(
        "query_id", "chunk_id", "score", "rank")


def _reranked(spark: SparkSession, sf: str, corpus) -> DataFrame:
    hits = staged(_hits(spark, sf, corpus), "hits")
    return rerank(enrich_hits(hits, corpus.children), tables.questions(spark, sf))


@query("rerank_overlap", f"WITH {_RERANKED} SELECT query_id, chunk_id, parent_chunk_id, score, rank FROM reranked")
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf, corpus_of(spark, sf)).select(
        "query_id", "chunk_id", "parent_chunk_id", "score", "rank")


def _selected(spark: SparkSession, sf: str, corpus) -> DataFrame:
    reranked = staged(_reranked(spark, sf, corpus), "reranked")
    return mmr_select(attach_vectors(reranked, corpus.vectors), questions(spark, sf))


@query("mmr_topk", f"WITH {_RERANKED}, {_mmr_steps('reranked')} SELECT query_id, chunk_id, score, rank FROM selected")
def mmr_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, corpus_of(spark, sf)).select("query_id", "chunk_id", "score", "rank")


@query("expand_parents", f"""WITH {_EVIDENCE}
SELECT query_id, rank, section_id, paper_id, title AS paper_title, published_date, md5(text) AS text_md5 FROM sections""")
def expand_parents_query(spark: SparkSession, sf: str) -> DataFrame:
    corpus = corpus_of(spark, sf)
    selected = staged(_selected(spark, sf, corpus), "selected")
    return expand_parents(selected, corpus.chunks, corpus.papers).select(
        "query_id", "rank", "section_id", "paper_id", "paper_title", "published_date",
        F.md5("text").alias("text_md5"))


_ASK = rf"""{_EVIDENCE},
tops AS (SELECT query_id, max(score) AS top_score FROM selected GROUP BY query_id),
labelled AS (
  SELECT query_id, rank, paper_id, '[Source: ' || CASE WHEN title <> '' THEN title ELSE paper_id END
         || ', ' || substr(published_date, 1, 4) || '] [Body]' || chr(10) || text AS block
  FROM sections),
sized AS (SELECT *, {sql.n_tokens("block")} AS tok FROM labelled),
summed AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sized),
parts AS (
  SELECT query_id, rank, least(tok, 6000 - (used - tok)) AS size,
         CASE WHEN used <= 6000 THEN block
              ELSE array_to_string(regexp_extract_all(block, '\s*\S+')[1 : CAST(6000 - (used - tok) AS BIGINT)], '') END AS piece
  FROM summed WHERE used <= 6000 OR 6000 - (used - tok) >= 200),
context AS (
  SELECT query_id, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context,
         CAST(sum(size) AS INTEGER) AS context_tokens, CAST(count(*) AS INTEGER) AS n_sections
  FROM parts GROUP BY query_id),
cited AS (
  SELECT query_id, string_agg(paper_id, ',' ORDER BY first) AS cited_papers
  FROM (SELECT query_id, paper_id, min(rank) AS first FROM sections GROUP BY ALL) GROUP BY query_id)"""


@query("ask_evidence", f"""WITH {_ASK}
SELECT t.query_id, 'research' AS intent, t.top_score, t.top_score >= 0.6 AS sufficient,
       CASE WHEN t.top_score >= 0.6 THEN 'generate_ask' ELSE 'ask_corrective' END AS route,
       coalesce(c.n_sections, 0) AS n_sections, coalesce(c.context_tokens, 0) AS context_tokens,
       md5(coalesce(c.context, '')) AS context_md5, coalesce(d.cited_papers, '') AS cited_papers,
       0 AS n_media
FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(top_score, 0) AS top_score
      FROM benchmark LEFT JOIN tops ON tops.query_id = CAST(item_id AS VARCHAR)) t
LEFT JOIN context c USING (query_id) LEFT JOIN cited d USING (query_id)""")
def ask_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: all benchmark questions from search to graded, budgeted context."""
    corpus = corpus_of(spark, sf)
    queries = prepare_queries(tables.questions(spark, sf), corpus)
    return summarize(gather_evidence(queries, corpus, limit=_LIMIT))


# --- Suggestions, candidates, correction --------------------------------------------------

_SUGGEST = f"""{sql.PAPERS}, {sql.children()}, {sql.bm25(*_PASSAGES, idf=False, avg_len="256")},
{sql.ranked("sparse", "top", 1)},
asked AS (SELECT query_id, paper_id AS own FROM top),
corpus_score AS (SELECT s.* FROM sparse s JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.paper_id WHERE l.quality = 1),
{sql.ranked("corpus_score", "hits", 3)},
own_hits AS (SELECT DISTINCT h.query_id FROM hits h JOIN asked a ON a.query_id = h.query_id AND a.own = h.paper_id),
healthy AS (SELECT * FROM asked WHERE query_id IN (SELECT query_id FROM own_hits) OR CAST(query_id AS BIGINT) % 2 = 0),
usable AS (SELECT h.query_id, h.paper_id, min(h.rank) AS best FROM hits h JOIN healthy a USING (query_id)
           WHERE h.paper_id <> a.own GROUP BY ALL),
{sql.ranked("usable", "corpus", 5, "best, paper_id")},
spare AS (SELECT s.query_id, s.paper_id, s.score, s.chunk_id FROM sparse s LEFT JOIN labels l
          ON CAST(l.doc_id AS VARCHAR) = s.paper_id WHERE l.doc_id IS NULL),
{sql.ranked("spare", "spare_top", 30)},
spare_best AS (SELECT query_id, paper_id, min(rank) AS best FROM spare_top
  WHERE query_id IN (SELECT query_id FROM healthy) AND query_id NOT IN (SELECT query_id FROM usable) GROUP BY ALL),
{sql.ranked("spare_best", "reserve", 5, "best, paper_id")}"""


@query("suggest_papers", f"""WITH {_SUGGEST}
SELECT c.query_id, c.rank AS position, c.paper_id, p.title,
  CASE WHEN length(p.abstract) > 0 THEN substr(p.abstract, 1, 200) END AS abstract_snippet, 'corpus' AS reason
FROM corpus c JOIN papers p USING (paper_id)
UNION ALL SELECT query_id, 1, NULL, '', NULL, 'index_drift' FROM asked
  WHERE CAST(query_id AS BIGINT) % 2 = 1 AND query_id NOT IN (SELECT query_id FROM own_hits)
UNION ALL SELECT r.query_id, r.rank, r.paper_id, p.title, substr(p.abstract, 1, 200), 'reserve'
FROM reserve r JOIN papers p USING (paper_id)""")
def suggest_papers_query(spark: SparkSession, sf: str) -> DataFrame:
    """Good documents are the corpus, unlabelled ones the reserve. Odd questions are deep dives
    into the paper that matches best."""
    docs = tables.documents(spark, sf)
    terms = sparse_encode_queries(tables.questions(spark, sf))
    # One pass over the vectors ranks the corpus, the reserve and the other labelled documents apart.
    good = tables.read(spark, sf, "labels").groupBy(F.col("doc_id").cast("string").alias("paper_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"))
    side = F.when(F.col("good"), "corpus").when(~F.col("good"), "labelled").otherwise("reserve")
    sided = _sparse(tables.children(docs), 256.0).join(good, "paper_id", "left").withColumn("side", side)
    found = staged(sparse_search(terms, sided, 30, "side"), "hits")
    odd = F.col("query_id").cast("bigint") % 2 == 1
    queries = top_k(found.drop("rank"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 1).select(
        "query_id", "paper_id", F.when(odd, "deep_dive").otherwise("ask").alias("mode"))
    hits = found.filter("side = 'corpus' AND rank <= 3")
    own = hits.join(queries.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_semi")
    papers = staged(tables.papers(docs).join(found.select("paper_id").distinct(), "paper_id", "left_semi"), "papers")
    return suggest_papers(queries, hits, papers, own, found.filter("side = 'reserve'"), papers)


@query("candidates", f"""WITH {sql.PAPERS},
heads AS (SELECT paper_id, title || ' ' || abstract AS text FROM papers), {sql.bm25("heads", "paper_id", "paper_id", "text", idf=True)},
{sql.ranked("sparse", "list0", 5)},
{sql.bm25("papers", "paper_id", "paper_id", "text", idf=True)
    .replace("doc_words", "doc_words1").replace("doc_terms", "doc_terms1").replace("tf AS", "tf1 AS").replace("FROM tf)", "FROM tf1)")
    .replace("FROM tf GROUP", "FROM tf1 GROUP").replace("postings", "postings1").replace("stats", "stats1")
    .replace("query_terms", "query_terms1").replace("sparse AS", "sparse1 AS")},
{sql.ranked("sparse1", "list1", 5)},
seen AS (SELECT query_id, paper_id, min(list_no * 100 + rank) AS first FROM (
  SELECT query_id, paper_id, 0 AS list_no, rank FROM list0 UNION ALL SELECT query_id, paper_id, 1, rank FROM list1) GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS pool_rank FROM seen),
marks AS (SELECT query_id, paper_id FROM seen JOIN labels l ON CAST(l.doc_id AS VARCHAR) = paper_id WHERE l.quality = 1),
kept AS (SELECT p.query_id, p.paper_id, CAST(pool_rank AS INTEGER) AS pool_rank FROM pool p WHERE pool_rank <= 6 AND (
  (query_id, paper_id) IN (SELECT (query_id, paper_id) FROM marks)
  OR (pool_rank = 1 AND query_id NOT IN (SELECT query_id FROM marks)))),
{sql.ranked("kept", "best", 3, "pool_rank")} SELECT query_id, paper_id, pool_rank, rank AS position FROM best""")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Two result lists per question, by head lines and by whole text; good papers are marked."""
    docs = tables.documents(spark, sf)
    heads = tables.papers(docs).select(F.col("paper_id").alias("chunk_id"), "paper_id",
                                       F.concat_ws(" ", "title", "abstract").alias("text"))
    lists = []
    for number, texts in enumerate((heads, _bm25_documents(spark, sf))):
        counts = stage_term_counts(texts)
        terms = sparse_encode_queries(
            tables.questions(spark, sf), term_statistics(counts), texts.agg(F.count("*")).scalar())
        found = sparse_search(terms, sparse_encode_documents(texts, counts=counts), 5)
        lists.append(found.select("query_id", F.lit(number).alias("list_no"), "rank", "paper_id"))
    results = staged(lists[0].unionByName(lists[1]), "lists")
    good = tables.read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("paper_id"))
    relevant = results.select("query_id", "paper_id").join(good, "paper_id", "left_semi")
    return select_candidates(results, relevant)


@query("corrective")
def corrective(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are the corpus; questions they cannot answer pull in others."""
    docs = tables.documents(spark, sf)
    labelled = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("paper_id"))
    papers = tables.papers(docs)
    inside, outside = (papers.join(labelled, "paper_id", how) for how in ("left_semi", "left_anti"))
    corpus = build_corpus(inside, tables.blocks(docs.join(labelled, "paper_id", "left_semi")), _settings())
    reserve = build_reserve(outside, tables.blocks(docs))
    queries = staged(prepare_queries(tables.questions(spark, sf), corpus), "queries")
    done = corrective_search(queries, corpus, reserve)
    return summarize(done.evidence)
