"""The corpus pipeline: each stage takes and returns documents, written as Parquet in between.

Rows with null in other columns pass through. Null and empty texts have no letter, so the first stage
drops them. Columns beyond those of ``documents`` stay, up to the last stage. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrag.llm import langid, mixing, ngram_join, sentencepieces, substring
from corrag.llm.common import numbered
from corrag.session import new_shared_path

#: Least posterior of the best language.
LANGUAGE_SCORE = 0.5
#: Words of a shingle, and percent of similarity, of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Token shares of the mixture. Documents of the first domain are clean: it keeps its natural total.
MIXTURE, CLEAN = {"high": 0.93, "low": 0.06, "toxic": 0.01}, "high"
VOCABULARY = "piece_bpe_32k.model"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (4): documents of no known language go, all others stay as they are."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    scored = langid.predict(docs, model, lang_out="_lang", score_out="_score")
    return scored.filter((F.col("_lang") != "und") & (F.col("_score") >= LANGUAGE_SCORE)).drop("_lang", "_score")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (1): of each group of near copies the document with the smallest id stays.

    Rows that repeat an id are one document and stay together; a null id is never a copy.
    """
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    copies = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (9): words in repeated windows go, wherever they stand; every document stays."""
    cleaned = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights (10): documents of low quality and toxic ones are thinned out to their
    share; a document that is most likely clean stays at least once. Rows are told apart by a number of
    their own: ids may be null or repeat."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", mixing.label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    rows = numbered(docs, "_row")
    mixed = mixing.mix_documents(rows.select("_row", "doc_id", "text"), labelled, MIXTURE, anchor=CLEAN, row_col="_row")
    clean = F.get("posterior", F.lit(sorted(MIXTURE).index(CLEAN))) >= 0.5
    times = F.when(clean, F.greatest("copies", F.lit(1))).otherwise(F.col("copies"))
    taken = mixed.select("_row", times.alias("_times")).filter("_times > 0")
    return (rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
            .select(docs.columns))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (7): ids in place of the text, with the results of the checks
    against the library's own ids and against the decoded text."""
    import public_tokenizers

    return sentencepieces.encode_documents(docs, public_tokenizers.path(VOCABULARY)).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("near_copies", near_copy_stage),
    ("repeats", repeat_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Several stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
