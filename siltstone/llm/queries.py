"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from siltstone.llm import bestfit, bitslice, divergence, exact_dedup, langid, line_dedup, mixing, pieces, simhash, token_counts, token_files, variants, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_warc": warc.op2_warc,
    "op3_token_files": token_files.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_bitslice_topk": bitslice.op5_bitslice_topk,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": langid.op9_language_id,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_bestfit_packing": bestfit.op11_bestfit_packing,
    "op12_divergence_audit": divergence.op12_divergence_audit,
    "op13_spelling_variants": variants.op13_spelling_variants,
}
ORACLES = {"op2_warc": warc.ORACLE, "op5_bitslice_topk": bitslice.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op12_divergence_audit": divergence.ORACLE, "op13_spelling_variants": variants.ORACLE}
