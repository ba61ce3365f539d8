"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from graphweft.llm import language, lattice, minhash, mixing, packing, quality, suffix, topk, warc, windows


def queries() -> dict:
    return {
        "op1_lattice_near_dedup": lattice.query,
        "op2_maxscore_topk": topk.query,
        "op3_quality_classifier": quality.query,
        "op4_minhash_forest": minhash.query,
        "op5_seekable_warc": warc.query,
        "op6_suffix_array_dedup": suffix.query,
        "op7_source_mixing": mixing.query,
        "op8_compact_windows": windows.query,
        "op9_language_mixture": language.query,
        "op10_best_fit_packing": packing.query,
    }


def oracle_sql() -> dict:
    return {"op1_lattice_near_dedup": lattice.ORACLE, "op2_maxscore_topk": topk.ORACLE, "op4_minhash_forest": minhash.ORACLE, "op5_seekable_warc": warc.ORACLE, "op7_source_mixing": mixing.ORACLE}
