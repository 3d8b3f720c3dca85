"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ann, bpe, chat, decontaminate, html_text, language_model, merkle, neardup, packing, quality, sharding, substring_dedup, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1,
        "op2_suffix_dedup": substring_dedup.op2,
        "op3_chat": chat.op3,
        "op4_sharding": sharding.op4,
        "op5_minhash": neardup.op5,
        "op6_suffix_tree": language_model.op6,
        "op7_bpe": bpe.op7,
        "op8_ann": ann.op8,
        "op9_html": html_text.op9,
        "op10_quality": quality.op10,
        "op11_packing": packing.op11,
        "op12_merkle": merkle.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op5_minhash": neardup.OP5_SQL, "op12_merkle": merkle.OP12_SQL}
