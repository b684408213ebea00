"""Importing this module registers every query."""

from corpusgraph.plans import (  # noqa: F401
    q_graph, q_ingest, q_ner, q_rank, q_reports, q_retrieval, q_roles, q_stats, q_streaming, q_text, q_windows)
