"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, source mixing."""

from cyclora.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
