"""All registered queries of this subpackage (imports register them)."""

from __future__ import annotations

from lodestar.llm import (  # noqa: F401
    q_chat,
    q_decontam,
    q_fim,
    q_html,
    q_lm,
    q_minhash,
    q_mixing,
    q_quality,
    q_sharding,
    q_suffix,
    q_tokens,
    q_toxicity,
    q_trie,
)
from lodestar.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
