"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from . import ann, bpe, html, interactions, mixing, quality, simhash, substring, topk, toxicity, turntrie, urls, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_topk": topk.op2_topk,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_ann": ann.op5_ann,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring": substring.op8_substring,
    "op9_html": html.op9_html,
    "op10_simhash": simhash.op10_simhash,
    "op11_urls": urls.op11_urls,
    "op12_turntrie": turntrie.op12_turntrie,
    "op13_interactions": interactions.op13_interactions,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op3_warc": warc.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op11_urls": urls.ORACLE,
    "op12_turntrie": turntrie.ORACLE,
    "op13_interactions": interactions.ORACLE,
}
