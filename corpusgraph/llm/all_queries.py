"""Importing this module registers every query of the subpackage."""

from corpusgraph.llm import (  # noqa: F401
    q_chat, q_contentsort, q_decontaminate, q_hamming, q_language, q_licenses, q_merkle, q_mixing, q_neardup, q_pst, q_sharedrank,
    q_suffix, q_tokens)
from corpusgraph.llm.queries import QUERIES, SQL  # noqa: F401
