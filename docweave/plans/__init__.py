"""The registry, filled by importing every module of queries."""

from docweave.plans import (  # noqa: F401
    dialogue_queries,
    evaluation_queries,
    extraction_queries,
    generic_queries,
    graph_queries,
    intake_queries,
    mode_queries,
    relational_queries,
    retrieval_queries,
    search_queries,
    sink_queries,
    state_queries,
    stream_queries,
    text_queries,
    understanding_queries,
)
from docweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
