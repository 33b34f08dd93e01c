"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .html import op5_html_text
from . import decontaminate, language_model, licenses, merkle, near_duplicates, pii, quality, sharding, whitening
from .toxicity import op8_toxicity
from .urls import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ngram_jaccard": near_duplicates.op2_ngram_jaccard,
    "op3_licenses": licenses.op3_licenses,
    "op4_quality": quality.op4_quality,
    "op5_html_text": op5_html_text,
    "op6_sharding": sharding.op6_sharding,
    "op7_language_model": language_model.op7_language_model,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_pii": pii.op11_pii,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle": merkle.op13_merkle,
}

#: The others are trained, banded or iterative; tests hold them against brute force, the public library or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_quality": quality.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
