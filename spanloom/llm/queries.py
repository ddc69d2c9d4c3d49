"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from spanloom.llm import decontaminate, fingerprint, line_dedup, near_dedup, quality, secret_scan, sentencepiece_codec, substring_dedup, url_filter, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_warc": warc.op5_warc,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}

#: Tokens and sketches can't be told in SQL; tests hold those queries against other code.
ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
}
