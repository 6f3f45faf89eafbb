"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import op1_suffix, op2_quality, op3_bpe, op4_hilbert, op5_secrets, op6_minhash, op7_chat, op8_gru, op9_trees, op10_packing
from . import op11_fim, op12_runs, op13_parsing

QUERIES = {
    "op1_suffix_dedup": op1_suffix.op1_suffix_dedup,
    "op2_quality": op2_quality.op2_quality,
    "op3_bpe": op3_bpe.op3_bpe,
    "op4_hilbert": op4_hilbert.op4_hilbert,
    "op5_secrets": op5_secrets.op5_secrets,
    "op6_near_duplicates": op6_minhash.op6_near_duplicates,
    "op7_preferences": op7_chat.op7_preferences,
    "op8_gru": op8_gru.op8_gru,
    "op9_substrings": op9_trees.op9_substrings,
    "op10_packing": op10_packing.op10_packing,
    "op11_fim": op11_fim.op11_fim,
    "op12_runs": op12_runs.op12_runs,
    "op13_fingerprints": op13_parsing.op13_fingerprints,
}

SQL = {
    "op1_suffix_dedup": op1_suffix.SQL,
    "op2_quality": op2_quality.SQL,
    "op4_hilbert": op4_hilbert.SQL,
    "op6_near_duplicates": op6_minhash.SQL,
    "op7_preferences": op7_chat.SQL,
    "op9_substrings": op9_trees.SQL,
    "op11_fim": op11_fim.SQL,
}
