"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import balltree, decontaminate, jaccard, language, lines, mixing, pii, quality, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.query,
    "op2_line_dedup": lines.query,
    "op3_resharding": sharding.query,
    "op4_balltree": balltree.query,
    "op5_decontamination": decontaminate.query,
    "op6_language": language.query,
    "op7_jaccard": jaccard.query,
    "op8_quality": quality.query,
    "op9_warc": warc.query,
    "op10_mixing": mixing.query,
}

ORACLES: dict[str, str] = {
    "op4_balltree": balltree.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_jaccard": jaccard.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
