"""One query for each corpus operator, with its production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from . import ann, langid, minhash, mixing, packing, partenum, quality, repair, simhash, substring, suffix, vafile, warc

QUERIES = {
    "op1_warc_revisit": warc.op1_warc_revisit,
    "op2_hnsw_search": ann.op2_hnsw_search,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op4_ngram_jaccard": partenum.op4_ngram_jaccard,
    "op5_fingerprints": minhash.op5_fingerprints,
    "op6_packing": packing.op6_packing,
    "op7_suffix_array_dedup": suffix.op7_suffix_array_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": langid.op10_language_id,
    "op11_simhash": simhash.op11_simhash,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_hard_negatives": vafile.op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_warc_revisit": warc.SQL,
    "op3_substring_dedup": substring.SQL,
    "op4_ngram_jaccard": partenum.SQL,
    "op7_suffix_array_dedup": suffix.SQL,
    "op9_mixing": mixing.SQL,
    "op12_conversation_repair": repair.SQL,
    "op13_hard_negatives": vafile.SQL,
}
