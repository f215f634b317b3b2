"""Queries of this subpackage, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayforge.llm.ann import op4_ann_search
from assayforge.llm.fingerprint import op2_document_fingerprint
from assayforge.llm.html_extract import op5_html_extract
from assayforge.llm.language_id import op6_language_id
from assayforge.llm.license_scan import op9_license_scan
from assayforge.llm.near_dedup import op3_minhash_near_dedup
from assayforge.llm.packing import op7_best_fit_packing
from assayforge.llm.quality import op8_quality_classifier
from assayforge.llm.substring_dedup import op1_substring_dedup
from assayforge.llm.word_bpe import op10_bpe_codec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_document_fingerprint": op2_document_fingerprint,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_ann_search": op4_ann_search,
    "op5_html_extract": op5_html_extract,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_license_scan": op9_license_scan,
    "op10_bpe_codec": op10_bpe_codec,
}

#: Words by the same pattern, windows as lists of 20 words; first by (doc_id, start).
OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM t WHERE len(w) >= 20),
keyed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM win),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE n > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
}
