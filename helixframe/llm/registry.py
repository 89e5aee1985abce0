"""Queries of the ten operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from helixframe.llm.html_text import op8_html_extraction
from helixframe.llm.language import op4_language_id
from helixframe.llm.lm_scoring import op9_lm_scoring
from helixframe.llm.media import op5_media_columns
from helixframe.llm.mixing import OP1_SQL, op1_mix_sources
from helixframe.llm.near_dedup import op2_minhash_near_dedup
from helixframe.llm.packing import op3_packing
from helixframe.llm.quality import op10_quality_classifier
from helixframe.llm.warc import op6_warc_fixity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_media_columns": op5_media_columns,
        "op6_warc_fixity": op6_warc_fixity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_quality_classifier": op10_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op7_exact_dedup": OP7_SQL}
