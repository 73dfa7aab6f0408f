"""Tunable constants of search, ranking, chunking and dialogue, with the defaults that queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Search:
    rrf_constant: int = 60
    arm_factor: int = 2  # hybrid search looks at this many times k in each arm
    ranked_factor: int = 3
    semantic: float = 0.35
    keyword: float = 0.30
    metadata: float = 0.20
    freshness: float = 0.15
    freshness_days: float = 365.0
    candidates_factor: int = 4
    candidates_most: int = 60
    passages: int = 2  # of one document
    overview_passages: int = 4


@dataclass(frozen=True)
class Context:
    boost_each: float = 0.02
    boost_most: float = 0.1
    graph_factor: float = 0.7
    graph_least: float = 0.3
    graph_default: float = 0.5
    duplicate_overlap: float = 0.6
    prompt_chars: int = 24_000
    memory_chars: int = 4_000


@dataclass(frozen=True)
class Dialogue:
    history_messages: int = 12
    message_chars: int = 1_500
    history_chars: int = 8_000
    snapshots_kept: int = 100


@dataclass(frozen=True)
class Evidence:
    overlap: int = 3
    coverage: float = 0.40
    least_tokens: int = 3
    references: int = 3


SEARCH, CONTEXT, DIALOGUE, EVIDENCE = Search(), Context(), Dialogue(), Evidence()
