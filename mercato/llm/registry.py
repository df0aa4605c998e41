"""Registered queries of the package and their oracle SQL.

Queries without SQL (recurrent network, learned models, byte merges, XXH64
fingerprints, page trees, run grammars, packings) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.llm import (bpe, contamination, htmltext, langid, licenses, lines, negatives, packing, periodic, quality,
                         sharding, simhash, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.op1,
    "op2_html_text": htmltext.op2,
    "op3_decontamination": contamination.op3,
    "op4_line_rules": lines.op4,
    "op5_language_id": langid.op5,
    "op6_quality": quality.op6,
    "op7_simhash": simhash.op7,
    "op8_licenses": licenses.op8,
    "op9_toxicity": toxicity.op9,
    "op10_extendible_shards": sharding.op10,
    "op11_periodic_runs": periodic.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_packing": packing.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": contamination.ORACLE,
    "op4_line_rules": lines.ORACLE,
    "op10_extendible_shards": sharding.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
