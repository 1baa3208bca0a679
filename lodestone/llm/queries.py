"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, merkle, mixing, ngram_join, quality, repair, rules, secrets, substrings, surrogates, toxicity, urls

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substrings": substrings.op3_substrings,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_surrogates": surrogates.op5_surrogates,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_urls": urls.op7_urls,
    "op8_quality": quality.op8_quality,
    "op9_rules": rules.op9_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle": merkle.op11_merkle,
    "op12_repair": repair.op12_repair,
    "op13_chat": chat.op13_chat,
}
ORACLES = {
    "op1_secrets": secrets.OP1_SQL,
    "op3_substrings": substrings.OP3_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_repair": repair.OP12_SQL,
    "op13_chat": chat.OP13_SQL,
}
