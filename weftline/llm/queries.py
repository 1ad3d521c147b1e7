"""Queries of this subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, fingerprint, jaccard, language, mixing, pii, tokencount, toxicity, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": jaccard.contract,
        "op2_pii": pii.contract,
        "op3_mixing": mixing.contract,
        "op4_document_fingerprints": fingerprint.contract,
        "op5_language_id": language.contract,
        "op6_warc": warc.contract,
        "op7_benchmark_decontamination": decontaminate.contract,
        "op8_url_filters": urlfilter.contract,
        "op9_token_counts": tokencount.contract,
        "op10_toxicity": toxicity.contract,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL, "op7_benchmark_decontamination": decontaminate.ORACLE_SQL, "op8_url_filters": urlfilter.ORACLE_SQL}
