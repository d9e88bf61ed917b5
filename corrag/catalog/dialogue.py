"""Sessions, intents, request checks, history, context, prompts, citations, media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrag.catalog import sqltext as sql
from corrag.catalog import tables
from corrag.catalog.registry import query
from corrag.functions.rules import (
    classify_intent, route_after_classify, route_after_corrective, wants_recent)
from corrag.operators.filters import check_requests
from corrag.operators.prompt import (
    assemble_prompts, build_context, citations, media_markdown, trim_history)
from corrag.operators.sessions import (
    assemble_turns, chat_history, deep_dive_ready, list_sessions, session_visible, sessions_for_client)

# --- Intents, routes, requests ------------------------------------------------------------

# The patterns of intents and recency, as SQL needs them.
_CHITCHAT = (r"(?i)^((hi|hii+|hey+|hello|hiya|yo|sup|howdy|gm|gn)( (there|everyone|all|folks))?"
             r"|good\s+(morning|afternoon|evening|night)|thanks?|thank\s+you|thx|ty|ok(ay)?|cool|nice|great"
             r"|awesome|lol|bye|goodbye|how\s+are\s+you|who\s+are\s+you|what\s+can\s+you\s+do)[\s!.?,]*$")
_UNNAMED = r"(?i)(^|[^\p{L}\p{N}_])(this|these|those|the\s+above|the\s+aforementioned)\s+papers?($|[^\p{L}\p{N}_])"
_RECENT = (r"(?i)(^|[^\p{L}\p{N}_])(recent|recently|latest|newest|this year|up[\s-]?to[\s-]?date"
           r"|state[\s-]?of[\s-]?the[\s-]?art|sota|2024|2025|2026)($|[^\p{L}\p{N}_])")

_SAID = """said AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'deep_dive' ELSE 'ask' END AS mode,
    CASE length(text) % 6 WHEN 0 THEN ' Hello there! ' WHEN 1 THEN 'Compare these papers: ' || text
      WHEN 2 THEN 'What is the latest on ' || text WHEN 3 THEN 'state-of-the art ' || text ELSE text END AS message,
    CASE length(text) % 7 WHEN 0 THEN ' CHAT. ' WHEN 1 THEN 'Clarify!' WHEN 2 THEN '"general"'
      WHEN 3 THEN 'not chat' WHEN 4 THEN 'research' END AS verdict
  FROM conversations)"""


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """Every message, some behind a greeting or a phrase, with a model's verdict on most."""
    size = F.length("text")
    kind, reply = size % 6, size % 7
    return tables.read(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "deep_dive").otherwise("ask").alias("mode"),
        F.when(kind == 0, F.lit(" Hello there! ")).when(kind == 1, F.concat(F.lit("Compare these papers: "), "text"))
        .when(kind == 2, F.concat(F.lit("What is the latest on "), "text"))
        .when(kind == 3, F.concat(F.lit("state-of-the art "), "text")).otherwise(F.col("text")).alias("message"),
        F.when(reply == 0, " CHAT. ").when(reply == 1, "Clarify!").when(reply == 2, '"general"')
        .when(reply == 3, "not chat").when(reply == 4, "research").alias("verdict"))


@query("intent", rf"""WITH {_SAID}, labelled AS (
  SELECT *, {sql.strip("message")} AS m,
    regexp_replace(lower({sql.strip("verdict")}), '^[.!?,''" ]+|[.!?,''" ]+$', '', 'g') AS v FROM said),
i AS (SELECT conv_id, turn, CASE WHEN m = '' OR regexp_matches(m, '{_CHITCHAT}') THEN 'chat'
  WHEN mode <> 'deep_dive' AND regexp_matches(m, '{_UNNAMED}') THEN 'clarify'
  WHEN v IS NULL OR v NOT IN ('chat', 'clarify', 'general') THEN 'research'
  WHEN mode = 'deep_dive' AND v <> 'chat' THEN 'research' ELSE v END AS intent FROM labelled)
SELECT conv_id, turn, intent, CASE WHEN intent = 'research' THEN 'retrieve' ELSE intent END AS route,
  CASE WHEN turn < 2 THEN 'retrieve' ELSE 'generate_ask' END AS after_corrective FROM i""")
def intent(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _said(spark, sf).withColumn(
        "intent", classify_intent(F.col("message"), F.col("mode"), F.col("verdict")))
    return labelled.select("conv_id", "turn", "intent", route_after_classify(F.col("intent")).alias("route"),
                           route_after_corrective(F.col("turn")).alias("after_corrective"))


@query("recency", rf"WITH {_SAID} SELECT conv_id, turn, regexp_matches(message, '{_RECENT}') AS wants_recent FROM said")
def recency(spark: SparkSession, sf: str) -> DataFrame:
    return _said(spark, sf).select("conv_id", "turn", wants_recent(F.col("message")).alias("wants_recent"))


@query("request_checks", rf"""WITH r AS (
  SELECT conv_id, turn, text AS content, CASE conv_id % 4 WHEN 0 THEN 'deep_dive' WHEN 1 THEN 'other' ELSE 'ask' END AS mode,
    CASE WHEN conv_id % 8 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END AS paper_id,
    CASE WHEN turn = 0 THEN '  ' ELSE text END AS title FROM conversations)
SELECT conv_id, turn, concat_ws(', ', CASE WHEN mode NOT IN ('ask', 'deep_dive') THEN 'unknown mode' END,
  CASE WHEN mode = 'deep_dive' AND paper_id = '' THEN 'deep_dive without paper_id' END,
  CASE WHEN length(content) < 1 OR length(content) > 8000 THEN 'message length' END,
  CASE WHEN {sql.strip("title")} = '' THEN 'blank title' END,
  CASE WHEN length(title) > 120 THEN 'title length' END) AS violations FROM r""")
def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    requests = tables.read(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("content"),
        F.when(c % 4 == 0, "deep_dive").when(c % 4 == 1, "other").otherwise("ask").alias("mode"),
        F.when(c % 8 == 0, "").otherwise(c.cast("string")).alias("paper_id"),
        F.when(F.col("turn") == 0, "  ").otherwise(F.col("text")).alias("title"))
    return check_requests(requests).select("conv_id", "turn", F.array_join("violations", ", ").alias("violations"))


# --- Sessions -----------------------------------------------------------------------------

_SESSIONS = """sessions AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 7 > 0 THEN 'c' || conv_id % 7 END AS client_id,
    CASE WHEN conv_id % 3 = 0 THEN 'deep_dive' ELSE 'ask' END AS mode, CAST(conv_id AS VARCHAR) AS paper_id,
    CASE WHEN conv_id % 5 = 0 THEN 'Saved ' || conv_id END AS title, conv_id % 50 AS created
  FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    text = c.cast("string")
    return tables.read(spark, sf, "conversations").select("conv_id").distinct().select(
        text.alias("session_id"), F.when(c % 7 > 0, F.concat(F.lit("c"), (c % 7).cast("string"))).alias("client_id"),
        F.when(c % 3 == 0, "deep_dive").otherwise("ask").alias("mode"), text.alias("paper_id"),
        F.when(c % 5 == 0, F.concat(F.lit("Saved "), text)).alias("title"),
        F.timestamp_seconds((c % 50) * 60).alias("created_at"))


@query("sessions_list", f"""WITH {_SESSIONS},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created DESC, session_id) AS position
  FROM sessions WHERE client_id IS NOT NULL) WHERE position <= 50),
firsts AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_min(text, turn) AS f FROM conversations
  WHERE role = 'user' GROUP BY conv_id),
named AS (SELECT t.*, f.f, replace({sql.strip("f.f")}, chr(10), ' ') AS line FROM top t LEFT JOIN firsts f USING (session_id))
SELECT client_id, CAST(position AS INTEGER) AS position, session_id, CASE WHEN title IS NOT NULL THEN title
  WHEN coalesce(f, '') <> '' THEN substr(line, 1, 60) || CASE WHEN length(line) > 60 THEN '…' ELSE '' END
  WHEN mode = 'deep_dive' THEN 'Deep Dive · ' || paper_id ELSE 'New chat' END AS title FROM named""")
def sessions_list(spark: SparkSession, sf: str) -> DataFrame:
    return list_sessions(_sessions(spark, sf), tables.messages(spark, sf), every_client=True).select(
        "client_id", "position", "session_id", "title")


@query("session_access", f"""WITH {_SESSIONS}
SELECT session_id, coalesce(client_id = 'c1', FALSE) AS listed, client_id IS NULL OR client_id = 'c1' AS visible,
  mode <> 'deep_dive' OR d.doc_id IS NOT NULL AS ready
FROM sessions LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = paper_id""")
def session_access(spark: SparkSession, sf: str) -> DataFrame:
    """What one client may list and open, and which sessions have their paper."""
    sessions = _sessions(spark, sf)
    mine = sessions_for_client(sessions, "c1").select("session_id", F.lit(True).alias("listed"))
    papers = tables.papers(tables.documents(spark, sf))
    return deep_dive_ready(sessions, papers).join(mine, "session_id", "left").select(
        "session_id", F.coalesce("listed", F.lit(False)).alias("listed"),
        session_visible(F.col("client_id"), "c1").alias("visible"), "ready")


@query("chat_history", """WITH now AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT CAST(c.conv_id AS VARCHAR) AS session_id, c.turn, c.role, md5(c.text) AS content_md5
FROM conversations c JOIN now USING (conv_id) WHERE c.turn < now.t""")
def chat_history_query(spark: SparkSession, sf: str) -> DataFrame:
    """What was said before the last user message of every session."""
    messages = tables.messages(spark, sf)
    current = messages.filter("role = 'user'").groupBy("session_id").agg(F.max("turn").alias("turn"))
    return chat_history(messages, current).select("session_id", "turn", "role", F.md5("content").alias("content_md5"))


@query("history_trim", f"""WITH m AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, {sql.n_tokens("text")} AS tokens FROM conversations),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC) AS used FROM m)
SELECT session_id, turn, role, tokens FROM s WHERE used <= 150""")
def history_trim(spark: SparkSession, sf: str) -> DataFrame:
    return trim_history(tables.messages(spark, sf), 150).select("session_id", "turn", "role", "tokens")


_TURN_EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS turn_id, event_id AS seq, ts,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'citation' ELSE 'token' END AS type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
te AS (SELECT *, CASE type WHEN 'token' THEN k || ' ' WHEN 'done' THEN CASE WHEN k % 2 = 1 THEN 'final ' || k END
    WHEN 'error' THEN CASE WHEN k < 50 THEN 'rate_limited' ELSE 'error' END END AS content FROM ev)"""


def turn_events(events: DataFrame) -> DataFrame:
    """The event log as turns: one per user and day."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
            .when(F.col("event_type") == "signup", "citation").otherwise("token"))
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("turn_id"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
        F.when(kind == "token", F.concat(k.cast("string"), F.lit(" ")))
        .when((kind == "done") & (k % 2 == 1), F.concat(F.lit("final "), k.cast("string")))
        .when(kind == "error", F.when(k < 50, "rate_limited").otherwise("error")).alias("content"),
        F.when(kind == "citation", F.concat(F.lit("paper-"), k.cast("string"))).alias("arxiv_id"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("abstract_snippet"))


_TURN_TEXT = """ends AS (SELECT session_id, turn_id, bool_or(type = 'done') AS done,
    coalesce(bool_or(content = 'rate_limited') FILTER (type = 'error'), FALSE) AS limited
  FROM te WHERE type IN ('done', 'error') GROUP BY ALL),
last_done AS (SELECT session_id, turn_id, content FROM (SELECT *, row_number() OVER (
    PARTITION BY session_id, turn_id ORDER BY seq DESC) AS n FROM te WHERE type = 'done') WHERE n = 1),
toks AS (SELECT session_id, turn_id, string_agg(content, '' ORDER BY seq) AS text FROM te WHERE type = 'token' GROUP BY ALL),
cites AS (SELECT session_id, turn_id, count(*) AS n FROM te WHERE type = 'citation' GROUP BY ALL)"""


@query("turns", f"""WITH {_TURN_EVENTS}, {_TURN_TEXT}
SELECT e.session_id, e.turn_id, md5(CASE WHEN e.done THEN coalesce(d.content, t.text, '')
    WHEN e.limited THEN '⚠️ Too many requests at the moment; this question can be asked again shortly.'
    ELSE '⚠️ This question could not be answered; something failed on the way.' END) AS content_md5,
  CASE WHEN e.done THEN coalesce(c.n, 0) ELSE 0 END AS n_cited
FROM ends e LEFT JOIN last_done d USING (session_id, turn_id) LEFT JOIN toks t USING (session_id, turn_id)
LEFT JOIN cites c USING (session_id, turn_id)""")
def turns(spark: SparkSession, sf: str) -> DataFrame:
    messages, cited = assemble_turns(turn_events(tables.read(spark, sf, "events")))
    counts = cited.groupBy("session_id", "turn_id").agg(F.count("*").alias("_n"))
    return messages.join(counts, ["session_id", "turn_id"], "left").select(
        "session_id", "turn_id", F.md5("content").alias("content_md5"), F.coalesce("_n", F.lit(0)).alias("n_cited"))


# --- Context, prompts, citations, media ---------------------------------------------------

def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as sections: one query per source, ranked by id; some are media."""
    lines = F.split("text", "\n")
    docs = tables.read(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.md5("text").alias("paper_id"),
        F.get(lines, F.lit(0)).alias("paper_title"),
        F.when(F.col("lang") != "de", F.concat((F.lit(2000) + F.col("n_chars") % 25).cast("string"), F.lit("-05-01")))
        .alias("published_date"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("abstract"),
        F.when(F.col("lang") != "es", F.lit("Body")).alias("section_title"), "text",
        F.when(F.col("lang") == "en", "table").when(F.col("lang") == "fr", "figure").otherwise("text").alias("content_type"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("https://x/"), F.md5("text"))).alias("media_url"))


_SECTIONS = """sections AS (
  SELECT source AS query_id, doc_id AS rank, md5(text) AS paper_id, string_split(text, chr(10))[1] AS paper_title,
    CASE WHEN lang <> 'de' THEN CAST(2000 + n_chars % 25 AS VARCHAR) || '-05-01' END AS published_date,
    coalesce(string_split(text, chr(10))[2], '') AS abstract, CASE WHEN lang <> 'es' THEN 'Body' END AS section_title, text,
    CASE lang WHEN 'en' THEN 'table' WHEN 'fr' THEN 'figure' ELSE 'text' END AS content_type,
    CASE WHEN n_chars % 2 = 0 THEN 'https://x/' || md5(text) END AS media_url FROM documents)"""

_CONTEXT = rf"""labelled AS (
  SELECT query_id, rank, '[Source: ' || CASE WHEN paper_title <> '' THEN paper_title ELSE paper_id END
    || coalesce(', ' || substr(published_date, 1, 4), '') || ']' || coalesce(' [' || section_title || ']', '')
    || chr(10) || text AS block FROM sections),
sized AS (SELECT *, {sql.n_tokens("block")} AS tok FROM labelled),
summed AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM sized),
parts AS (SELECT query_id, rank, least(tok, 6000 - (used - tok)) AS size, CASE WHEN used <= 6000 THEN block
    ELSE array_to_string(regexp_extract_all(block, '\s*\S+')[1 : CAST(6000 - (used - tok) AS BIGINT)], '') END AS piece
  FROM summed WHERE used <= 6000 OR 6000 - (used - tok) >= 200),
context AS (SELECT query_id, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context,
    CAST(sum(size) AS INTEGER) AS context_tokens, CAST(count(*) AS INTEGER) AS n_sections FROM parts GROUP BY query_id)"""


@query("context_budget", f"""WITH {_SECTIONS}, {_CONTEXT}
SELECT query_id, md5(context) AS context_md5, context_tokens, n_sections FROM context""")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    return build_context(_sections(spark, sf)).select(
        "query_id", F.md5("context").alias("context_md5"), "context_tokens", "n_sections")


@query("citations", f"""WITH {_SECTIONS}, firsts AS (
  SELECT query_id, paper_id, min(rank) AS rank FROM sections GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position, f.paper_id,
  s.paper_title AS title, CASE WHEN length(s.abstract) > 0 THEN substr(s.abstract, 1, 200) END AS abstract_snippet
FROM firsts f JOIN sections s USING (query_id, rank)""")
def citations_query(spark: SparkSession, sf: str) -> DataFrame:
    return citations(_sections(spark, sf))


@query("media_markdown", f"""WITH {_SECTIONS}, items AS (
  SELECT query_id, rank, CASE WHEN content_type = 'table' THEN 't:' || paper_id || ':' || {sql.strip("text")}
      ELSE 'f:' || media_url END AS key,
    CASE WHEN content_type = 'table' THEN '**Table — ' || CASE WHEN paper_title <> '' THEN paper_title ELSE paper_id END
        || '**' || chr(10) || chr(10) || {sql.strip("text")}
      ELSE '![' || CASE WHEN {sql.strip("text")} <> '' THEN {sql.strip("text")} ELSE 'Figure' END || '](' || media_url || ')' END AS item
  FROM sections WHERE (content_type = 'table' AND {sql.strip("text")} <> '') OR (content_type = 'figure' AND media_url IS NOT NULL)),
d AS (SELECT query_id, key, min(rank) AS rank FROM items GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM d) WHERE n <= 6)
SELECT k.query_id, CAST(count(*) AS INTEGER) AS n_items,
  md5(chr(10) || chr(10) || string_agg(i.item, chr(10) || chr(10) ORDER BY k.rank)) AS markdown_md5
FROM k JOIN items i ON i.query_id = k.query_id AND i.rank = k.rank GROUP BY k.query_id""")
def media_markdown_query(spark: SparkSession, sf: str) -> DataFrame:
    return media_markdown(_sections(spark, sf)).select("query_id", "n_items", F.md5("markdown").alias("markdown_md5"))


TEMPLATES = {"chat": "Chat.", "clarify": "Ask back.", "general": "Explain.", "ask": "Answer from the sources.",
             "deep_dive": "Answer from this paper."}


@query("prompts", f"""WITH {_SECTIONS}, {_CONTEXT}, {_SAID},
now AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
q AS (SELECT n.conv_id, n.turn, c.text, s.mode, ['chat', 'clarify', 'general', 'research', 'research'][n.conv_id % 5 + 1] AS intent
  FROM now n JOIN conversations c USING (conv_id, turn) JOIN said s USING (conv_id, turn)),
h AS (SELECT c.conv_id, c.turn, c.role, c.text, sum({sql.n_tokens("c.text")}) OVER (
        PARTITION BY c.conv_id ORDER BY c.turn DESC) AS used
      FROM conversations c JOIN q USING (conv_id) WHERE c.turn < q.turn),
past AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS text, count(*) AS n
         FROM h WHERE used <= 300 GROUP BY conv_id)
SELECT CAST(q.conv_id AS VARCHAR) AS query_id, CAST(coalesce(p.n, 0) + 2 AS INTEGER) AS n_messages,
  md5('system:' || CASE WHEN intent = 'chat' THEN 'Chat.' WHEN intent = 'clarify' THEN 'Ask back.'
    WHEN intent = 'general' THEN 'Explain.' WHEN mode = 'deep_dive' THEN 'Answer from this paper.'
    ELSE 'Answer from the sources.' END || CASE WHEN intent = 'research' AND x.context IS NOT NULL THEN
      chr(10) || chr(10) || 'Data only.' || chr(10) || chr(10) || '<retrieved_context>' || chr(10) || x.context || chr(10)
      || '</retrieved_context>' ELSE '' END
    || coalesce(chr(10) || p.text, '') || chr(10) || 'user:' || q.text) AS messages_md5
FROM q LEFT JOIN past p USING (conv_id) LEFT JOIN context x ON x.query_id = 'src' || q.conv_id % 25""")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The messages for the last user turn of every session."""
    messages = tables.messages(spark, sf)
    last = messages.filter("role = 'user'").groupBy("session_id").agg(
        F.max_by(F.struct("turn", "content"), "turn").alias("_m")).select("session_id", "_m.turn", "_m.content")
    c = F.col("session_id").cast("bigint")
    kinds = F.array(*(F.lit(x) for x in ("chat", "clarify", "general", "research", "research")))
    queries = last.select(
        F.col("session_id").alias("query_id"), F.when(c % 3 == 0, "deep_dive").otherwise("ask").alias("mode"),
        F.get(kinds, (c % 5).cast("int")).alias("intent"), F.col("content").alias("user_message"),
        F.concat(F.lit("src"), (c % 25).cast("string")).alias("_source"))
    history = trim_history(chat_history(messages, last), 300).withColumnRenamed("session_id", "query_id")
    context = build_context(_sections(spark, sf)).withColumnRenamed("query_id", "_source")
    mine = queries.join(context, "_source").select("query_id", "context")
    made = assemble_prompts(queries, mine, history, TEMPLATES, "Data only.")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return made.select("query_id", F.size("messages").alias("n_messages"), F.md5(flat).alias("messages_md5"))
