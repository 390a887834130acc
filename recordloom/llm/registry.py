"""Registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from recordloom.llm import audio, chunks, minhash, mixing, multiindex, negatives, packing, pitman_yor, quality, toxicity, urls, vectorcodes, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": chunks.op2_substring_dedup,
    "op3_pitman_yor": pitman_yor.op3_pitman_yor,
    "op4_audio_features": audio.op4_audio_features,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard_join": minhash.op7_ngram_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_filters": urls.op9_url_filters,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_embedding_dedup": multiindex.op12_embedding_dedup,
    "op13_vector_codes": vectorcodes.op13_vector_codes,
}

SQL = {
    "op5_mixing": mixing.SQL,
    "op6_warc": warc.SQL,
    "op9_url_filters": urls.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_embedding_dedup": multiindex.SQL,
    "op13_vector_codes": vectorcodes.SQL,
}
