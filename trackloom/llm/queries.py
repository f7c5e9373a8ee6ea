"""The queries of this subpackage, and SQL for those that SQL can express."""

import corpus_pipeline

from . import decontamination, fill_in_middle, fingerprints, html_extraction, language_id, line_dedup, manifest, mixing, ngram_join, permutation_index, pseudonyms, substring_dedup, token_output

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_token_id_output": token_output.op7_token_id_output,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_pii_pseudonyms": pseudonyms.op10_pii_pseudonyms,
    "op11_nearest_neighbours": permutation_index.op11_nearest_neighbours,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op4_ngram_jaccard_join": ngram_join.SQL,
    "op6_source_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
