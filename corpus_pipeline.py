"""The corpus pipeline's stages: what ``tailframe.llm.pipeline`` defines, where callers look for it. Goes with that folder."""

from tailframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
