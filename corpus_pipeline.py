"""The corpus pipeline: STAGES, run and ORACLE_SQL."""

from tapeloom.llm.corpus import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
