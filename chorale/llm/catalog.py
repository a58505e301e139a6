"""The queries of this subpackage and their SQL; importing it fills the two tables."""

from __future__ import annotations

from chorale.llm import q_corpus, q_text, q_web  # noqa: F401
from chorale.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
