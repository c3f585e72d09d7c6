"""Every query of the library by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import compare_queries, hygiene_queries, match_queries, prompt_queries, score_queries, stem_queries, taxonomy_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
