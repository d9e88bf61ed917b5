"""Quality rules with adaptive thresholds, in DataFrame and SQL functions only.

Every text gets counts and four shares. A mergeable quantile sketch (``percentile_approx``) per
language and source, per language, and over all gives the quartiles of each share; a text is kept
when it passes the base rule and no share lies outside the fences of its own group:
``max(q3 + 3 (q3 - q1), q3 + slack)`` above, and for the word length also below.
A group with fewer than ``MIN_ROWS`` passing texts borrows the fences of its language, a language
with fewer those of all rows.

Defined results: null and empty texts have zero counts and fail the base rule. Null language or
source is a group of its own. Equal texts get equal counts; repeated rows stay repeated. Without a
group of ``MIN_ROWS`` texts no fence exists and the base rule alone decides. Texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrag.llm.common import read_table, words_of
from corrag.session import staged

SYMBOLS = "#*$%&|<>"
#: Rows a group needs for fences of its own.
MIN_ROWS = 30
#: 1 / relative rank error of the sketches.
ACCURACY = 10_000
#: Least distance of a fence from its quartile, for each share.
SLACK = {"symbol_share": 0.1, "dup_line_share": 0.3, "repeat_share": 0.2, "word_length": 3.0}
SPREAD = 3.0
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"_w": words_of(F.col(text_col)), "_lines": lines})
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    # A window's key holds its hash above and its place below, so that one sort of numbers brings
    # equal windows together in text order; equal neighbours are then compared word by word.
    rows = rows.withColumn("_bits", F.length(F.bin(F.col("n_words"))))
    rows = rows.withColumn("_keys", F.expr(
        "CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform("
        "sequence(0L, n_words - 3), i -> shiftleft(shiftrightunsigned("
        "xxhash64(get(_w, int(i)), get(_w, int(i) + 1), get(_w, int(i) + 2)), _bits), _bits) | i)) END"))
    rows = rows.withColumn("_same", F.expr(
        "CASE WHEN size(_keys) < 2 THEN CAST(array() AS array<boolean>) ELSE transform("
        "sequence(0, size(_keys) - 2), j -> _window_equal(j)) END".replace("_window_equal(j)", (
            "shiftrightunsigned(get(_keys, j), _bits) = shiftrightunsigned(get(_keys, j + 1), _bits) AND "
            "slice(_w, int(get(_keys, j) & (shiftleft(1L, _bits) - 1)) + 1, 3) = "
            "slice(_w, int(get(_keys, j + 1) & (shiftleft(1L, _bits) - 1)) + 1, 3)"))))
    rows = rows.withColumn("_starts", F.expr(
        "sort_array(transform(filter(transform(_keys, (k, j) -> named_struct('k', k, 'twin', "
        "coalesce(get(_same, j), false) OR coalesce(get(_same, j - 1), false))), x -> x.twin), "
        "x -> x.k & (shiftleft(1L, _bits) - 1)))"))
    return rows.withColumn("n_repeat_words", F.expr(
        "aggregate(_starts, named_struct('end', 0L, 'n', 0L), (acc, s) -> named_struct("
        "'end', s + 3, 'n', acc.n + s + 3 - greatest(acc.end, s)), acc -> acc.n)")
    ).drop("_w", "_bits", "_keys", "_same", "_starts")


def with_shares(counted: DataFrame) -> DataFrame:
    return counted.withColumns({
        "symbol_share": F.try_divide("n_symbols", "word_chars"),
        "dup_line_share": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_share": F.try_divide("n_repeat_words", "n_words"),
        "word_length": F.try_divide("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def fences(shares: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of fences per language and source: at most languages x sources rows."""
    def fence(share, q):
        reach = F.greatest(SPREAD * (q[2] - q[0]), F.lit(SLACK[share]))
        return F.struct((q[0] - reach).alias("low"), (q[2] + reach).alias("high"))

    def sketch(out, **keys):
        passing = shares.filter(~F.col("base_failed")).select(*SLACK, *(c.alias(k) for k, c in keys.items()))
        made = passing.groupBy(*keys).agg(F.count("*").alias("n"), *(
            F.percentile_approx(s, [0.25, 0.5, 0.75], ACCURACY).alias(s) for s in SLACK))
        made = made.filter(F.col("n") >= MIN_ROWS)
        return made.select(*keys, F.struct(*(fence(s, F.col(s)).alias(s) for s in SLACK)).alias(out))

    lang, source = F.col(lang_col), F.col(source_col)
    groups = shares.select(lang.alias("_lang"), source.alias("_source")).distinct()
    fine = sketch("_fine", _l=lang, _s=source)
    middle = sketch("_middle", _ml=lang)
    coarse = sketch("_coarse").select("_coarse").scalar()  # one value
    return (
        groups.join(fine, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
        .join(middle, F.col("_lang").eqNullSafe(F.col("_ml")), "left")
        .select("_lang", "_source", F.coalesce("_fine", "_middle", coarse).alias("_fence")))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the text, with counts, shares, ``base_failed`` and ``kept``."""
    shares = staged(with_shares(count_text(docs, text_col)).drop(text_col), "quality-shares")
    table = fences(shares, lang_col, source_col)
    inside = F.lit(True)
    for share in SLACK:
        value, fence = F.col(share), F.col("_fence")[share]
        good = value <= fence["high"]
        if share == "word_length":
            good = good & (value >= fence["low"])
        inside = inside & F.coalesce(good, F.lit(True))
    same = shares[lang_col].eqNullSafe(table["_lang"]) & shares[source_col].eqNullSafe(table["_source"])
    return (
        shares.join(table, same, "left")
        .withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "_source", "_fence"))


def query_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select("doc_id", *_COUNTS, "base_failed", "kept")


_QUARTILES = ", ".join(
    f"min({s}) FILTER ({s}_r >= ceil({q} * n)) AS {s}_{q[2:]}" for s in SLACK for q in ("0.25", "0.75"))


def _sql_level(name: str, keys: str) -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY {{}})"
    ranks = ", ".join(f"row_number() {over.format(s)} AS {s}_r" for s in SLACK)
    fence = ", ".join(
        f"{s}_25 - greatest({SPREAD} * ({s}_75 - {s}_25), {SLACK[s]}) AS {s}_low, "
        f"{s}_75 + greatest({SPREAD} * ({s}_75 - {s}_25), {SLACK[s]}) AS {s}_high" for s in SLACK)
    return (f"{name} AS (SELECT {keys}, true AS there, {fence} FROM (SELECT {keys}, {_QUARTILES} FROM ("
            f"SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, {ranks} FROM shares WHERE NOT base_failed) "
            f"WHERE n >= {MIN_ROWS} GROUP BY {keys}))")


def _sql_inside(alias: str) -> str:
    return " AND ".join([f"{s} <= {alias}.{s}_high" for s in SLACK] + [f"word_length >= {alias}.word_length_low"])


ORACLE_QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twins AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twins) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
shares AS (
  SELECT *, n_symbols / nullif(word_chars, 0)::DOUBLE AS symbol_share,
         n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_share,
         n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeat_share,
         word_chars / nullif(n_words, 0)::DOUBLE AS word_length,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts),
{_sql_level("fine", "lang, source")},
{_sql_level("middle", "lang")},
{_sql_level("coarse", "1 + 0 * length('')").replace("SELECT 1 + 0 * length('')", "SELECT 1 AS one").replace(
    "GROUP BY 1 + 0 * length('')", "GROUP BY ALL")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE
         WHEN f.there THEN {_sql_inside("f")}
         WHEN m.there THEN {_sql_inside("m")}
         WHEN c.there THEN {_sql_inside("c")}
         ELSE true END AS kept
FROM shares
LEFT JOIN fine f ON f.lang IS NOT DISTINCT FROM shares.lang AND f.source IS NOT DISTINCT FROM shares.source
LEFT JOIN middle m ON m.lang IS NOT DISTINCT FROM shares.lang
LEFT JOIN coarse c ON c.there
"""
