"""The queries of the corpus operators."""

from __future__ import annotations

from weft.llm import archives, bpe, chunks, covertree, decontaminate, html, lm, neardup, negatives, oracles, quality, quotes, resample, secrets

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quote_links": quotes.op2_quote_links,
    "op3_attention_scores": lm.op3_attention_scores,
    "op4_host_suffixes": html.op4_host_suffixes,
    "op5_chunk_dedup": chunks.op5_chunk_dedup,
    "op6_cover_tree": covertree.op6_cover_tree,
    "op7_quality_votes": quality.op7_quality_votes,
    "op8_prob_minhash": neardup.op8_prob_minhash,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_secret_links": secrets.op10_secret_links,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_resample": resample.op12_resample,
    "op13_arc_converter": archives.op13_arc_converter,
}

#: The others are held against brute force in tests/llm.
ORACLE = {"op6_cover_tree": oracles.OP6, "op8_prob_minhash": oracles.OP8, "op11_hard_negatives": oracles.OP11, "op12_resample": oracles.OP12, "op13_arc_converter": oracles.OP13}
