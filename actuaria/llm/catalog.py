"""Registered queries of the training-data operators and their DuckDB twins."""
from __future__ import annotations

from actuaria.llm import alignment, fingerprint, fixity, jaccard, language, mixing, packing, periodic, repeats, secrets, simhash, tokens, topk

QUERIES = {
    "op1_fingerprints": fingerprint.fingerprint_documents,
    "op2_secret_scan": secrets.secret_scan,
    "ledger_passes": secrets.ledger_passes,
    "op3_mixture_schedule": mixing.mix_documents,
    "op4_repeat_removal": repeats.dedup_documents,
    "op5_topk_search": topk.nearest_embeddings,
    "op6_jaccard_join": jaccard.join_documents,
    "op7_packing": packing.pack_documents,
    "op8_fixity_audit": fixity.fixity_audit,
    "op8_record_audit": fixity.record_audit,
    "op9_language_id": language.identify_documents,
    "op10_token_counts": tokens.count_documents,
    "op11_periodic_runs": periodic.runs_documents,
    "op12_token_alignment": alignment.align_documents,
    "op13_simhash": simhash.simhash_documents,
}

ORACLE: dict[str, str] = {
    "ledger_passes": secrets.PASSES_SQL,
    "op5_topk_search": topk.NEAREST_SQL,
    "op8_fixity_audit": fixity.FIXITY_SQL,
    "op8_record_audit": fixity.RECORD_SQL,
}
