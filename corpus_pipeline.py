"""The corpus pipeline: quality rules, language, near copies, repeated passages, packing."""

from __future__ import annotations

from oncekeep.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
