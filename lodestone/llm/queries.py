"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm import merkle, mixing, neighbours, packing, pii, pitman_yor, quality, sentence_pieces, simhash, toxicity, urls, warc, whitening


def queries() -> dict:
    return {
        "op1_prefix_forest": neighbours.op1_prefix_forest,
        "op2_pii": pii.op2_pii,
        "op3_warc": warc.op3_warc,
        "op4_pitman_yor": pitman_yor.op4_pitman_yor,
        "op5_packing": packing.op5_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_url_filter": urls.op8_url_filter,
        "op9_simhash": simhash.op9_simhash,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_whitening": whitening.op11_whitening,
        "op12_sentence_pieces": sentence_pieces.op12_sentence_pieces,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality.oracle_op7(), "op13_merkle": merkle.oracle_op13()}
