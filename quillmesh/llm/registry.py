"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quillmesh.llm import brown_lm, chat, decontam, fingerprint, html_wrap, jaccard_join, mixing, pii, quality, url_trust

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1,
    "op2_quality": quality.op2,
    "op3_mixing": mixing.op3,
    "op4_brown_lm": brown_lm.op4,
    "op5_html_wrap": html_wrap.op5,
    "op6_chat_format": chat.op6,
    "op7_pii": pii.op7,
    "op8_url_trust": url_trust.op8,
    "op9_decontaminate": decontam.op9,
    "op10_fingerprint": fingerprint.op10,
}

ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op9_decontaminate": decontam.OP9_SQL,
}
