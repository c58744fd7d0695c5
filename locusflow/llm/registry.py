"""The text operators' queries, and DuckDB SQL where it can express them."""

from __future__ import annotations

from locusflow.llm import chat, decontaminate, fingerprint, mixing, passages, periodic, quality, resampling, sharding, simhash, suffix_dedup, toxicity, url_filter, surrogate

MODULES = (toxicity, decontaminate, surrogate, sharding, suffix_dedup, url_filter, fingerprint, mixing, quality, simhash, chat, resampling, periodic)


def queries():
    found = {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and callable(f)}
    return found | {"op5_suffix_dedup": passages.op5_suffix_dedup}


def oracle_sql():
    return {"op8_mix_sources": mixing.sql(), "op2_decontaminate": decontaminate.SQL, "op11_chat_format": chat.SQL, "op12_importance_resampling": resampling.SQL}
