"""Registered corpus queries and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from .binary_packing import op12_binary_packing
from .decontaminate import OP6_SQL, op6_decontamination
from .langid import op7_language_id
from .merkle import OP11_SQL, op11_merkle_manifest
from .minhash import OP1_SQL, op1_minhash_near_dedup
from .packing import op5_best_fit_packing
from .pii import op10_pii
from .quality import OP4_SQL, op4_adaptive_quality
from .quotes import op3_quotation_linking
from .spelling import OP13_SQL, op13_spelling_variants
from .substring import OP8_SQL, op8_substring_dedup
from .tokens import op2_token_store
from .warc import OP9_SQL, op9_arc_to_warc

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_store": op2_token_store,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_adaptive_quality": op4_adaptive_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_pii": op10_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_binary_packing": op12_binary_packing,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The others are tested against brute force, round trips or held-out accuracy.
ORACLES = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op4_adaptive_quality": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_arc_to_warc": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
