"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import covertree, decontaminate, hdlang, hpylm, htmltext, neardup, packing, secrets, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_section_tokens": tokencount.op1_section_tokens,
    "op2_covertree_neardup": covertree.op2_covertree_neardup,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_hpy_score": hpylm.op4_hpy_score,
    "op5_containment_search": decontaminate.op5_containment_search,
    "op6_hdc_language": hdlang.op6_hdc_language,
    "op7_charconv_secrets": secrets.op7_charconv_secrets,
    "op8_crf_extraction": htmltext.op8_crf_extraction,
    "op9_gga_packing": packing.op9_gga_packing,
    "op10_weak_toxicity": toxicity.op10_weak_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_covertree_neardup": covertree.OP2_SQL,
    "op5_containment_search": decontaminate.OP5_SQL,
}
