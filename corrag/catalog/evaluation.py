"""Grades, retrieval metrics, attribution, baselines and latency."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag.catalog import sqltext as sql
from corrag.catalog import tables
from corrag.catalog.registry import query
from corrag.catalog.retrieval import DIM, _EVIDENCE, corpus_of, questions, stored_impacts
from corrag.functions.text import tokens
from corrag.operators.evaluation import (
    CUTOFF,
    attribute_answers, attribution_averages, build_run, comparison_report, grading_metrics,
    latency_report, mrr, ndcg_at_k, recall_at_k, mrr_of_ranks, regressions, score_bands, score_histogram,
    score_sheet)
from corrag.operators.filters import grade
from corrag.operators.postings import (
    sparse_encode_documents, sparse_encode_queries, stage_term_counts, term_statistics)
from corrag.operators.impacts import impact_search, ranks_of
from corrag.plans.evaluate import retrieval_report
from corrag.session import staged
from corrag.sources.evalsets import load_eval_dataset_json, load_qrels_json, parse_flags


# --- Relevance from verbatim passages -----------------------------------------------------

#: Short passages that one pass over the documents looks for.
SHORT_PASSAGES = 256


def verbatim_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark passage word for word, whatever its length.

    Candidates share the hash of up to three successive inner tokens of the passage, an equi-join on
    short keys; the texts of these few pairs are then compared in full. A passage of one or two
    tokens has no inner token: such passages are looked for as they are, a block of them a pass.
    """
    passages = tables.read(spark, sf, "benchmark").filter(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("passage"))
    docs = tables.documents(spark, sf).select("paper_id", "text")
    cut = passages.withColumn("_t", tokens(F.col("passage")))
    keyed = cut.filter(F.size("_t") >= 3).select("query_id", F.xxhash64(F.array_join(F.slice(
        "_t", F.lit(2), F.least(F.lit(3), F.size("_t") - 2)), " ")).alias("_key"))
    split = docs.select("paper_id", tokens(F.col("text")).alias("_t"))
    places = split.select("paper_id", F.arrays_zip(
        F.col("_t").alias("a"), F.slice("_t", F.lit(2), F.size("_t")).alias("b"),
        F.slice("_t", F.lit(3), F.size("_t")).alias("c")).alias("_z"))
    words_at = places.select("paper_id", F.explode_outer("_z").alias("_w")).filter(
        F.col("_w").isNotNull())
    shingles = words_at.select("paper_id", F.explode(F.array(
        F.xxhash64("_w.a"), F.xxhash64(F.concat_ws(" ", "_w.a", "_w.b")),
        F.xxhash64(F.concat_ws(" ", "_w.a", "_w.b", "_w.c")))).alias("_key"))
    pairs = shingles.join(keyed, "_key").select("paper_id", "query_id").distinct()
    found = (docs.join(staged(pairs, "pairs"), "paper_id").join(passages, "query_id")
             .filter(F.contains("text", F.col("passage"))).select("query_id", "paper_id"))
    short = cut.filter(F.size("_t") < 3).select("query_id", "passage").toLocalIterator()
    while block := list(islice(short, SHORT_PASSAGES)):
        wanted = F.array(*(F.struct(F.lit(r.query_id).alias("id"), F.lit(r.passage).alias("passage")) for r in block))
        held = F.filter(wanted, lambda p: F.contains(F.col("text"), p["passage"]))
        found = found.unionAll(docs.select(F.explode(held).alias("_p"), "paper_id").select("_p.id", "paper_id"))
    return found.select("query_id", F.col("paper_id").alias("chunk_id"), F.lit(1).alias("relevance"))


_QRELS = """qrels AS MATERIALIZED (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS chunk_id, 1 AS relevance
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
judged AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id)"""


def _metrics(run: str) -> str:
    """Per query values of one run (``query_id, chunk_id, score``)."""
    return f"""m_ranked AS (SELECT *, row_number() OVER (PARTITION BY run_name, query_id
    ORDER BY score DESC, chunk_id) AS rank FROM {run}),
names AS (SELECT DISTINCT run_name FROM {run}),
m_rel AS (SELECT r.* FROM m_ranked r JOIN qrels USING (query_id, chunk_id)),
values_ AS (
  SELECT n.run_name, j.query_id, 'recall@5' AS metric,
         coalesce((SELECT count(*) FROM m_rel r WHERE r.run_name = n.run_name AND r.query_id = j.query_id AND rank <= 5), 0)
         / j.n::DOUBLE AS value FROM judged j, names n
  UNION ALL SELECT n.run_name, j.query_id, 'mrr', coalesce(1.0::DOUBLE / (SELECT min(rank) FROM m_rel r
         WHERE r.run_name = n.run_name AND r.query_id = j.query_id), 0) FROM judged j, names n
  UNION ALL SELECT n.run_name, j.query_id, 'ndcg@5', coalesce((SELECT sum(1 / log2(rank + 1)) FROM m_rel r
         WHERE r.run_name = n.run_name AND r.query_id = j.query_id AND rank <= 5), 0)
         / list_sum(list_transform(range(1, least(j.n, 5) + 1), lambda i: 1 / log2(i + 1))) FROM judged j, names n)"""


@query("verbatim_qrels", f"WITH {_QRELS} SELECT query_id, chunk_id, relevance FROM qrels")
def verbatim_qrels_query(spark: SparkSession, sf: str) -> DataFrame:
    return verbatim_qrels(spark, sf)


@query("retrieval_metrics", f"""WITH {_QRELS}, {sql.PAPERS}, {sql.bm25("papers", "paper_id", "paper_id", "text", idf=True)},
named AS (SELECT 'bm25' AS run_name, * FROM sparse), {_metrics("named")}
SELECT query_id, metric, round(value, 6) AS value FROM values_""")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per query metrics of the full BM25 ranking over documents: the best five and the ranks of judged
    documents come from the impact index, so the ranking itself is never made."""
    docs = tables.documents(spark, sf).select(F.col("paper_id").alias("chunk_id"), "paper_id", "text")
    counts = stage_term_counts(docs)
    terms = staged(sparse_encode_queries(
        tables.questions(spark, sf), term_statistics(counts), docs.agg(F.count("*")).scalar()), "terms")
    vectors = staged(sparse_encode_documents(docs, counts=counts), "sparse")
    index = stored_impacts(spark, vectors, terms)
    qrels = staged(verbatim_qrels(spark, sf), "qrels")
    best = staged(build_run(impact_search(terms, index, vectors, CUTOFF), "bm25"), "run")
    ranks = staged(ranks_of(terms, index, vectors, qrels.filter("relevance > 0")), "ranks")
    parts = [("recall@5", recall_at_k(qrels, best)), ("ndcg@5", ndcg_at_k(qrels, best)), ("mrr", mrr_of_ranks(qrels, ranks, "bm25"))]
    named = [values.select("query_id", F.lit(name).alias("metric"), F.round("value", 6).alias("value")) for name, values in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("comparison_report", f"""WITH {_QRELS}, {_EVIDENCE},
runs AS MATERIALIZED (
  SELECT 'dense' AS run_name, query_id, paper_id AS chunk_id, max(score) AS score FROM dense_top WHERE rank <= 30 GROUP BY ALL
  UNION ALL SELECT 'hybrid', query_id, paper_id, max(score) FROM hits GROUP BY ALL
  UNION ALL SELECT 'hybrid_rerank', query_id, paper_id, max(score) FROM reranked GROUP BY ALL),
{_metrics("runs")}
SELECT run_name, metric, round(avg(value), 6) AS value FROM values_ GROUP BY ALL""")
def comparison_report_query(spark: SparkSession, sf: str) -> DataFrame:
    """Dense, hybrid and reranked retrieval of the benchmark passages against each other."""
    qrels = staged(verbatim_qrels(spark, sf), "qrels")
    return retrieval_report(questions(spark, sf), qrels, corpus_of(spark, sf))


# --- Grades -------------------------------------------------------------------------------

_GRADES = f"""scored AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS query_id, CASE WHEN d.lang = 'en' THEN 'ask' ELSE 'deep_dive' END AS mode,
         round(least(1, len({sql.words("d.text")}) / 300.0::DOUBLE), 6) AS score, l.quality,
         CASE l.toxic WHEN 0 THEN ' Yes. fine' WHEN 1 THEN 'no.' END AS verdict
  FROM documents d LEFT JOIN labels l USING (doc_id)),
graded AS (SELECT *, CASE WHEN score >= 0.6 THEN 'score above threshold'
    WHEN score <= 0.35 AND mode <> 'deep_dive' THEN 'score below threshold' END AS decided FROM scored),
verdicts AS (SELECT *, CASE WHEN decided IS NOT NULL THEN score >= 0.6
    ELSE coalesce(starts_with(lower({sql.strip("verdict")}), 'yes'), FALSE) END AS sufficient FROM graded)"""


def _grades(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents stand for queries: their length is the score, their label the verdict."""
    docs = tables.documents(spark, sf)
    labels = tables.read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("query_id"), "quality",
        F.when(F.col("toxic") == 0, " Yes. fine").otherwise("no.").alias("verdict"))
    queries = docs.select(F.col("paper_id").alias("query_id"),
                          F.when(F.col("lang") == "en", "ask").otherwise("deep_dive").alias("mode"))
    hits = docs.select(F.col("paper_id").alias("query_id"), F.round(F.least(F.lit(1.0), F.size(
        F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) / 300.0), 6).alias("score"))
    return grade(queries, hits, labels), labels


@query("grades", f"""WITH {_GRADES}
SELECT query_id, score AS top_score, sufficient, coalesce(decided, lower({sql.strip("verdict")})) AS reason,
  decided IS NULL AND verdict IS NULL AS needs_judge FROM verdicts""")
def grades(spark: SparkSession, sf: str) -> DataFrame:
    return _grades(spark, sf)[0]


_GRADING = """counts AS (SELECT count(*) FILTER (sufficient AND quality = 1) AS tp, count(*) FILTER (sufficient AND quality = 0) AS fp,
  count(*) FILTER (NOT sufficient AND quality = 1) AS fn, count(*) FILTER (NOT sufficient AND quality = 0) AS tn
  FROM verdicts WHERE quality IS NOT NULL),
grading AS (
  SELECT 'accuracy' AS metric, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS value FROM counts
  UNION ALL SELECT 'fnr', round(coalesce(fn / nullif(fn + tp, 0)::DOUBLE, 0), 6) FROM counts
  UNION ALL SELECT 'fpr', round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) FROM counts)"""


def _grading(spark: SparkSession, sf: str) -> DataFrame:
    graded, labels = _grades(spark, sf)
    return grading_metrics(graded.join(labels.select("query_id", "quality"), "query_id").select(
        F.col("sufficient").alias("predicted"), (F.col("quality") == 1).alias("label")))


@query("grading_metrics", f"WITH {_GRADES}, {_GRADING} SELECT metric, value FROM grading")
def grading_metrics_query(spark: SparkSession, sf: str) -> DataFrame:
    return _grading(spark, sf)


@query("score_hist", f"""WITH {_GRADES}, r AS (SELECT min(score) AS lo, (max(score) - min(score)) / 20 AS w FROM scored),
b AS (SELECT CAST(least(floor((score - lo) / w), 19) AS INTEGER) AS bin, lo, w FROM scored, r)
SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*) AS n FROM b GROUP BY ALL""")
def score_hist(spark: SparkSession, sf: str) -> DataFrame:
    return score_histogram(_grades(spark, sf)[0], "top_score")


@query("score_bands", f"""WITH {_GRADES} SELECT CASE WHEN score >= 0.6 THEN 'high' WHEN score <= 0.35 THEN 'low'
  ELSE 'between' END AS band, count(*) AS n FROM scored GROUP BY ALL""")
def score_bands_query(spark: SparkSession, sf: str) -> DataFrame:
    return score_bands(_grades(spark, sf)[0], "top_score")


# --- Attribution --------------------------------------------------------------------------

_THRESHOLD = 0.4

_ATTRIBUTION = rf"""answers AS (
  SELECT conv_id || '/' || turn AS answer_id, CAST(conv_id AS VARCHAR) AS conv, text AS answer FROM conversations WHERE role = 'assistant'),
given AS (SELECT a.answer_id, c.turn AS chunk_id, c.text FROM answers a JOIN conversations c
          ON CAST(c.conv_id AS VARCHAR) = a.conv AND c.role = 'user'),
cut AS (SELECT answer_id, list_filter(string_split(regexp_replace({sql.strip("answer")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
          lambda s: s <> '') AS ss FROM answers),
sents AS (SELECT answer_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM cut),
users AS (SELECT conv_id || '/' || turn AS id, text FROM conversations WHERE role = 'user'),
keyed AS (SELECT answer_id || '|' || pos AS id, sentence FROM sents),
{sql.hash_vectors("sv", "keyed", "id", "sentence", DIM)},
{sql.hash_vectors("cv", "users", "id", "text", DIM)},
sn AS (SELECT id, sqrt(sum(v * v)) AS n FROM sv GROUP BY id), cn AS (SELECT id, sqrt(sum(v * v)) AS n FROM cv GROUP BY id),
sims AS (
  SELECT s.answer_id, s.pos, g.chunk_id, round(sum(x.v * y.v) / any_value(sn.n * cn.n), 6) AS sim
  FROM sents s JOIN given g USING (answer_id) JOIN sv x ON x.id = s.answer_id || '|' || s.pos
  JOIN cv y ON y.id = split_part(s.answer_id, '/', 1) || '/' || g.chunk_id AND y.bucket = x.bucket
  JOIN sn ON sn.id = x.id JOIN cn ON cn.id = y.id WHERE sn.n > 0 AND cn.n > 0 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, pos ORDER BY sim DESC, chunk_id) AS n FROM sims)
         WHERE n = 1 AND sim > 0 AND sim >= {_THRESHOLD}),
attributed AS (
  SELECT a.answer_id, {sql.strip("a.answer")} = '' AS blank_answer, count(s.pos) AS n_sentences,
    round(coalesce(count(b.pos) / nullif(count(s.pos), 0)::DOUBLE, 0), 6) AS attribution_rate,
    coalesce(string_agg(s.sentence, '|' ORDER BY s.pos) FILTER (s.pos IS NOT NULL AND b.pos IS NULL), '') AS unattributed,
    round(coalesce((SELECT count(DISTINCT chunk_id) FROM best u WHERE u.answer_id = a.answer_id)
      / nullif((SELECT count(*) FROM given g WHERE g.answer_id = a.answer_id), 0)::DOUBLE, 0), 6) AS chunk_utilization_rate
  FROM answers a LEFT JOIN sents s USING (answer_id) LEFT JOIN best b ON b.answer_id = s.answer_id AND b.pos = s.pos
  GROUP BY a.answer_id, a.answer)"""


def _attributed(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant messages as answers, the user messages of the same session as their chunks."""
    said = tables.read(spark, sf, "conversations")
    answers = said.filter("role = 'assistant'").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        "conv_id", F.col("text").alias("answer"))
    chunks = answers.select("answer_id", "conv_id").join(
        said.filter("role = 'user'").select("conv_id", F.col("turn").alias("chunk_id"), "text"), "conv_id")
    return attribute_answers(answers.select("answer_id", "answer"), chunks.drop("conv_id"), _THRESHOLD, dim=DIM)


@query("attribution", f"""WITH {_ATTRIBUTION}
SELECT answer_id, blank_answer, n_sentences, attribution_rate, md5(unattributed) AS unattributed_md5, chunk_utilization_rate
FROM attributed""")
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _attributed(spark, sf).select(
        "answer_id", "blank_answer", "n_sentences", "attribution_rate",
        F.md5(F.array_join("unattributed_sentences", "|")).alias("unattributed_md5"), "chunk_utilization_rate")


_SHEET = f"""{_GRADES}, {_GRADING}, {_ATTRIBUTION},
sheet AS (SELECT metric, value FROM grading
  UNION ALL SELECT 'attribution_rate', round(coalesce(avg(attribution_rate), 0), 6) FROM attributed WHERE NOT blank_answer
  UNION ALL SELECT 'chunk_utilization_rate', round(coalesce(avg(chunk_utilization_rate), 0), 6) FROM attributed WHERE NOT blank_answer
  UNION ALL SELECT 'faithfulness', round(avg(quality), 6) FROM labels
  UNION ALL SELECT 'answer_relevancy', round(avg(1 - toxic), 6) FROM labels)"""


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    judged = tables.read(spark, sf, "labels").select(F.explode(F.array(
        F.struct(F.lit("faithfulness").alias("metric"), F.col("quality").cast("double").alias("value")),
        F.struct(F.lit("answer_relevancy").alias("metric"), (1 - F.col("toxic")).cast("double").alias("value"))))
        .alias("m")).select("m.metric", "m.value")
    return score_sheet(_grading(spark, sf), judged, attribution_averages(_attributed(spark, sf)))


@query("score_sheet", f"WITH {_SHEET} SELECT metric, value FROM sheet")
def score_sheet_query(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf)


@query("regressions", f"""WITH {_SHEET}, base AS (
  SELECT event_type AS paper_id, m.metric, round(avg(value) / 50, 6) AS baseline FROM events,
    (SELECT metric FROM sheet UNION ALL SELECT 'absent') m GROUP BY ALL)
SELECT b.paper_id, s.metric, s.value AS current, b.baseline FROM base b JOIN sheet s USING (metric)
WHERE s.value < b.baseline - 0.05""")
def regressions_query(spark: SparkSession, sf: str) -> DataFrame:
    """Today's sheet against one baseline per event type; a metric that is absent is skipped."""
    sheet = staged(_sheet(spark, sf), "sheet")
    means = tables.read(spark, sf, "events").groupBy(F.col("event_type").alias("paper_id")).agg(
        F.round(F.avg("value") / 50, 6).alias("value"))
    names = sheet.agg(F.array_append(F.collect_list("metric"), F.lit("absent"))).scalar()
    baseline = means.select("paper_id", F.explode(names).alias("metric"), "value")
    current = means.select("paper_id", F.explode(sheet.agg(F.collect_list(F.struct("metric", "value"))).scalar())
                           .alias("m")).select("paper_id", "m.metric", "m.value")
    return regressions(current, baseline)


# --- Latency and evaluation sets ----------------------------------------------------------

@query("latency_report", """SELECT 'stage' AS kind, event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY ALL
UNION ALL SELECT 'calls', CAST(user_id % 5 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM events GROUP BY ALL""")
def latency_report_query(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.read(spark, sf, "events")
    return latency_report(
        events.select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")),
        events.select((F.col("user_id") % 5).cast("string").alias("provider"))).withColumn(
        "value", F.round("value", 4))


@query("qrels_json", """SELECT CAST(doc_id AS VARCHAR) AS query_id, 'c' || x AS chunk_id, 1 AS relevance
FROM (SELECT doc_id, unnest([doc_id, doc_id + 1]) AS x FROM documents WHERE n_chars % 4 < 2)""")
def qrels_json(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements as a model writes them: clean, wrapped in prose, without ids, not JSON."""
    d, kind = F.col("doc_id"), F.col("n_chars") % 4
    entry = F.array(F.struct(d.cast("string").alias("query"), F.array(*(
        F.concat(F.lit("c"), (d + i).cast("string")) for i in range(2))).alias("relevant_chunk_ids")))
    raw = tables.read(spark, sf, "documents").select(
        F.when(kind == 0, F.to_json(entry)).when(kind == 1, F.concat(F.lit("Here: "), F.to_json(entry), F.lit(" Done.")))
        .when(kind == 2, F.concat(F.lit('[{"query": "'), d.cast("string"), F.lit('"}]')))
        .otherwise(F.lit("no answer")).alias("raw"))
    return load_qrels_json(raw, "raw")


@query("eval_dataset_json", """SELECT md5(text) AS question_md5, CAST(doc_id AS VARCHAR) AS answer, 2 AS n_contexts, TRUE AS complete
FROM documents WHERE n_chars % 2 = 0
UNION ALL SELECT md5(text), '', 0, FALSE FROM documents WHERE n_chars % 2 = 1""")
def eval_dataset_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read(spark, sf, "documents")
    full = F.struct(F.col("text").alias("question"), F.col("doc_id").cast("string").alias("answer"),
                    F.array("lang", "source").alias("contexts"))
    raw = docs.select(F.when(F.col("n_chars") % 2 == 0, F.to_json(F.array(full))).otherwise(
        F.concat(F.lit("Sure. "), F.to_json(F.array(F.struct(F.col("text").alias("question")))))).alias("raw"))
    return load_eval_dataset_json(raw, "raw").select(
        F.md5("question").alias("question_md5"), F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce(F.size("contexts"), F.lit(0)).alias("n_contexts"), "complete")


@query("json_flags", """SELECT source, count(*) FILTER (n_chars % 3 <> 0) AS parsed, count(*) FILTER (n_chars % 3 = 0) AS unreadable
FROM documents GROUP BY source""")
def json_flags(spark: SparkSession, sf: str) -> DataFrame:
    """How many raw replies could be read, per source."""
    good = F.to_json(F.array(F.struct(F.col("text").alias("query"))))
    raw = tables.read(spark, sf, "documents").select("source", F.when(
        F.col("n_chars") % 3 == 0, F.lit("I cannot do that")).otherwise(good).alias("raw"))
    return parse_flags(raw, "raw").groupBy("source").agg(
        F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("unreadable"))
