"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemill.llm import conversations, decontaminate, html_text, langid, licenses, neardup, packing, secrets, substrings, tokens, topk, warc, whitening

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_language_id": langid.op2_language_id,
    "op3_jaccard_join": neardup.op3_jaccard_join,
    "op4_html_text": html_text.op4_html_text,
    "op5_packing": packing.op5_packing,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_substrings": substrings.op8_substrings,
    "op9_secrets": secrets.op9_secrets,
    "op10_topk": topk.op10_topk,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": conversations.op12_prefix_trie,
    "op13_licenses": licenses.op13_licenses,
}

#: The others are held against brute force in tests/llm.
ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op10_topk": topk.OP10_SQL,
    "op12_prefix_trie": conversations.OP12_SQL,
    "op13_licenses": licenses.OP13_SQL,
}
