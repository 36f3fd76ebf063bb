"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, fingerprints, lines, mixing, simhash, substrings, token_counts, tool_calls, toxicity, warc

MODULES = (warc, tool_calls, toxicity, simhash, fingerprints, decontaminate, lines, token_counts, substrings, mixing)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
