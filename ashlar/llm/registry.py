"""The queries of this package and the SQL that checks them, by name."""

from __future__ import annotations

from . import exact_dedup, licenses, mixing, neighbours, pii, preferences, quality, sentencepiece_trie, simhash, training_order

QUERIES = {
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_simhash": simhash.op3_simhash,
    "op1_mixing": mixing.op1_mixing,
    "op4_preferences": preferences.op4_preferences,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_sentencepiece": sentencepiece_trie.op8_sentencepiece,
    "op9_training_order": training_order.op9_training_order,
    "op10_pii": pii.op10_pii,
}

ORACLES = {
    "op4_preferences": preferences.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_licenses": licenses.OP6_SQL,
}
