"""Predicates and labels computed from text columns: intent, recency, routing, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrag.functions.text import strip_ws

# --- Fixed values: patterns and labels that decide results -------------------------------
GREETING_WORDS = "hi|hii+|hey+|hello|hiya|yo|sup|howdy|gm|gn"
GREETING_ADDRESSEES = "there|everyone|all|folks"
COURTESY_PHRASES = (
    r"good\s+(morning|afternoon|evening|night)"
    r"|thanks?|thank\s+you|thx|ty|ok(ay)?|cool|nice|great|awesome|lol|bye|goodbye"
    r"|how\s+are\s+you|who\s+are\s+you|what\s+can\s+you\s+do"
)
UNNAMED_PAPER_PHRASE = r"(this|these|those|the\s+above|the\s+aforementioned)\s+papers?"
RECENCY_TERMS = (
    r"recent|recently|latest|newest|this year|up[\s-]?to[\s-]?date"
    r"|state[\s-]?of[\s-]?the[\s-]?art|sota|2024|2025|2026"
)
INTENT_LABELS = ("chat", "clarify", "general")
VERDICT_TRIM = r"^[.!?,'\" ]+|[.!?,'\" ]+$"
LATEX_MARKUP = r"\$\$[\s\S]*?\$\$|\$[^$\n]*?\$|\\[a-zA-Z]+\{[^}]*\}|\\[a-zA-Z]+"
NEW_STYLE_ID = r"^\d{4}\.\d{4,5}(v\d+)?$"
OLD_STYLE_ID = r"^[a-z\-]+(\.[A-Z]{2})?/\d{7}(v\d+)?$"
UNSAFE_ID_CHARS = r"[^A-Za-z0-9._/-]"
EQUATION_MIN_PROSE = 150
GRADE_HIGH, GRADE_LOW = 0.6, 0.35
MAX_RETRIES = 2
# -----------------------------------------------------------------------------------------

# Word edges that know accented letters; the engine's own \b only knows ASCII.
_EDGE_BEFORE, _EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _as_word(pattern: str) -> str:
    return f"(?i){_EDGE_BEFORE}({pattern}){_EDGE_AFTER}"


def is_chitchat(message: Column, assistant_name: str | None = None) -> Column:
    """Greetings, thanks and questions about the assistant, with nothing after them."""
    addressees = GREETING_ADDRESSEES + (f"|{assistant_name}" if assistant_name else "")
    pattern = f"(?i)^(({GREETING_WORDS})( ({addressees}))?|{COURTESY_PHRASES})[\\s!.?,]*$"
    return message.rlike(pattern)


def names_unseen_papers(message: Column) -> Column:
    return message.rlike(_as_word(UNNAMED_PAPER_PHRASE))


def wants_recent(message: Column) -> Column:
    return message.rlike(_as_word(RECENCY_TERMS))


def classify_intent(
    message: Column, mode: Column, verdict: Column | None = None,
    assistant_name: str | None = None,
) -> Column:
    """chat, clarify, general or research; ``verdict`` is a model's raw reply or NULL."""
    text = strip_ws(F.coalesce(message, F.lit("")))
    deep = F.coalesce(mode, F.lit("ask")) == "deep_dive"
    reply = F.lit(None).cast("string") if verdict is None else verdict
    label = F.regexp_replace(F.lower(strip_ws(reply)), VERDICT_TRIM, "")
    judged = (
        F.when(~label.isin(*INTENT_LABELS), F.lit("research"))
        .when(deep & (label != "chat"), F.lit("research"))
        .otherwise(label))
    return (
        F.when((text == "") | is_chitchat(text, assistant_name), F.lit("chat"))
        .when(~deep & names_unseen_papers(text), F.lit("clarify"))
        .otherwise(F.coalesce(judged, F.lit("research"))))


def route_after_classify(intent: Column) -> Column:
    return F.when(intent.isin(*INTENT_LABELS), intent).otherwise(F.lit("retrieve"))


def route_after_grade(mode: Column, sufficient: Column) -> Column:
    enough = F.coalesce(sufficient, F.lit(False))
    return (
        F.when((mode == "deep_dive") & enough, F.lit("generate_deep_dive"))
        .when(mode == "deep_dive", F.lit("deep_dive_insufficient"))
        .when(enough, F.lit("generate_ask"))
        .otherwise(F.lit("ask_corrective")))


def route_after_corrective(retry_count: Column, max_retries: int = MAX_RETRIES) -> Column:
    return F.when(F.coalesce(retry_count, F.lit(0)) < max_retries, F.lit("retrieve")).otherwise(
        F.lit("generate_ask"))


def is_equation_only(text: Column, min_prose: int = EQUATION_MIN_PROSE) -> Column:
    """Has formula markup and fewer than ``min_prose`` characters besides it.

    Markup needs a dollar sign or a backslash; the plain search for these spares most texts
    the pattern.
    """
    prose = strip_ws(F.regexp_replace(text, LATEX_MARKUP, ""))
    may_have = F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\"))
    return may_have & text.rlike(LATEX_MARKUP) & (F.length(prose) < min_prose)


def valid_paper_id(paper_id: Column) -> Column:
    trimmed = strip_ws(paper_id)
    return F.coalesce(trimmed.rlike(NEW_STYLE_ID) | trimmed.rlike(OLD_STYLE_ID), F.lit(False))


def safe_path_id(paper_id: Column) -> Column:
    kept = F.replace(F.regexp_replace(paper_id, UNSAFE_ID_CHARS, ""), F.lit(".."), F.lit(""))
    return F.regexp_replace(kept, "^/+|/+$", "")


def canonical_paper_id(raw_id: Column) -> Column:
    """The id after the last ``/abs/`` without its version; other ids stay as they are."""
    trimmed = strip_ws(raw_id)
    tail = F.regexp_replace(F.substring_index(trimmed, "/abs/", -1), r"v\d+$", "")
    return F.when(F.contains(trimmed, F.lit("/abs/")), tail).otherwise(trimmed)


def grade_reason(
    top_score: Column, mode: Column, high: float = GRADE_HIGH, low: float = GRADE_LOW,
) -> Column:
    """Which threshold decides; NULL where only a judge can."""
    return (
        F.when(top_score >= high, F.lit("score above threshold"))
        .when((top_score <= low) & ~F.coalesce(mode == "deep_dive", F.lit(False)),
              F.lit("score below threshold")))


def says_yes(reply: Column) -> Column:
    return F.startswith(F.lower(strip_ws(reply)), F.lit("yes"))
