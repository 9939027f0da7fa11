"""The corpus pipeline, whose stages are in the subpackage of its operators."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
