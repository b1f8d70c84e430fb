"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (bpe, chat, decontaminate, embeddings, filter_audit, lattice, lexical, line_dedup, minhash, sharding,
               substring_dedup, token_blocks, toxicity)

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_rotation": chat.op3_chat_rotation,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_token_blocks": token_blocks.op5_token_blocks,
    "op6_minhash": minhash.op6_minhash,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sentencepiece": lattice.op9_sentencepiece,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_bpe": bpe.op11_bpe,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_chat_rotation": chat.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op10_embeddings": embeddings.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
