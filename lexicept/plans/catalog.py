"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

from . import q_concepts, q_eval, q_lexicon, q_phrases, q_scaling, q_stream, q_survey  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
