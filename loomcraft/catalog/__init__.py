"""The registered queries, each with the SQL it is checked against.

A query reads whole tables. Where an operator needs input the tables do not hold (tool
definitions, replies, chat records), the query derives it from them with expressions both engines
share, so its work grows with the tables.
"""

from __future__ import annotations

from . import (  # noqa: F401  (importing registers)
    conversations, prompts, replies, retrieval, scoring, sources, stages, texts, validation,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
