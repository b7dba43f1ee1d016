"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from foldquery.llm import chat_format, decontaminate, licenses, mjpeg, ngram_join, quality, sentencepiece, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_avi_mjpeg": mjpeg.op4_avi_mjpeg,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality_cotraining": quality.op9_quality_cotraining,
    "op10_chat_format": chat_format.op10_chat_format,
}

SQL = {
    "op1_license_scan": licenses.SQL,
    "op3_url_filter": url_filter.SQL,
    "op5_ngram_jaccard_join": ngram_join.SQL,
    "op10_chat_format": chat_format.SQL,
}
