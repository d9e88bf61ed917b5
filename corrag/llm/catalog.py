"""The registered queries of this package and their SQL counterparts."""

from corrag.llm import alignment, collocations, langid, mixing, neardup, ngram_join, oracles, quality, sentencepieces, sharding, substring, tokenfiles, toxicity, wrappers

QUERIES = {
    "op1_ngram_join": ngram_join.query_ngram_join,
    "op2_neardup": neardup.query_neardup,
    "op3_quality": quality.query_quality,
    "op4_langid": langid.query_langid,
    "op5_sharding": sharding.query_sharding,
    "op6_html": wrappers.query_html,
    "op7_sentencepiece": sentencepieces.query_sentencepiece,
    "op8_token_files": tokenfiles.query_token_files,
    "op9_substring": substring.query_substring,
    "op10_mixing": mixing.query_mixing,
    "op11_toxicity": toxicity.query_toxicity,
    "op12_alignment": alignment.query_alignment,
    "op13_collocations": collocations.query_collocations,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": oracles.NGRAM_JOIN,
    "op2_neardup": oracles.NEARDUP,
    "op3_quality": quality.ORACLE_QUALITY,
    "op9_substring": oracles.SUBSTRING,
    "op13_collocations": oracles.COLLOCATIONS,
}
