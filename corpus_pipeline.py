"""The corpus pipeline's stages, where the driver looks for them; see `pathlens.llm.pipeline`."""

from pathlens.llm.pipeline import ORACLE_SQL, STAGES, byte_bpe, language, mixture, near_dedup, repeats, run

__all__ = ["ORACLE_SQL", "STAGES", "byte_bpe", "language", "mixture", "near_dedup", "repeats", "run"]
