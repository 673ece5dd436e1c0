"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from trackforge.llm import q_bpe, q_chat, q_decontam, q_divergence, q_epsilon_grid, q_hmm, q_langid, q_licenses, q_minhash, q_pii, q_suffixes, q_urls, q_yinyang

QUERIES = {
    "op1_decontam": q_decontam.op1_decontam,
    "op2_bpe": q_bpe.op2_bpe,
    "op3_chat": q_chat.op3_chat,
    "op4_langid": q_langid.op4_langid,
    "op5_epsilon_grid": q_epsilon_grid.op5_epsilon_grid,
    "op6_urls": q_urls.op6_urls,
    "op7_licenses": q_licenses.op7_licenses,
    "op8_hmm": q_hmm.op8_hmm,
    "op9_pii": q_pii.op9_pii,
    "op10_minhash": q_minhash.op10_minhash,
    "op11_yinyang": q_yinyang.op11_yinyang,
    "op12_suffixes": q_suffixes.op12_suffixes,
    "op13_divergence": q_divergence.op13_divergence,
    # parts of their results that SQL can say
    "license_phrases": q_licenses.license_phrases,
    "pii_counts": q_pii.pii_counts,
    "unigram_scores": q_hmm.unigram_scores,
}
ORACLE_SQL = {
    "op1_decontam": q_decontam.SQL,
    "op3_chat": q_chat.SQL,
    "op5_epsilon_grid": q_epsilon_grid.SQL,
    "op6_urls": q_urls.SQL,
    "op10_minhash": q_minhash.SQL,
    "op11_yinyang": q_yinyang.SQL,
    "op13_divergence": q_divergence.SQL,
    "license_phrases": q_licenses.SQL,
    "pii_counts": q_pii.SQL,
    "unigram_scores": q_hmm.SQL,
}
