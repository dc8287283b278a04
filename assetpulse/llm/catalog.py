"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express.

Without SQL: toxicity and quality scores and language ids (fitted models;
tests check held-out accuracy), the chosen-path and vector joins (sampled
candidate search; tests compare with brute force), the hashed neighbour
search (sampled; tests measure its recall against brute force), token files, byte-level
BPE (libraries; tests compare with them) and language-model scores (sampled;
tests check the exact parts by brute force).
"""

from . import balltree, bpe, chosenpath, crosspolytope, decontaminate, langid, linededup, pitmanyor, pq, prefixtrie, quality, tokenfile, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_query,
    "op2_language": langid.op2_query,
    "op3_decontamination": decontaminate.op3_query,
    "op4_token_file": tokenfile.op4_query,
    "op5_line_dedup": linededup.op5_query,
    "op6_quality": quality.op6_query,
    "op7_ngram_join": chosenpath.op7_query,
    "op8_embedding_dedup": pq.op8_query,
    "op9_byte_bpe": bpe.op9_query,
    "op10_lm_score": pitmanyor.op10_query,
    "op11_ball_tree": balltree.op11_query,
    "op12_cross_polytope": crosspolytope.op12_query,
    "op13_prefix_trie": prefixtrie.op13_query,
}
ORACLES = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op11_ball_tree": balltree.OP11_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}
