"""The corpus pipeline's stages, as the driver looks for them; they live in ``strandline.llm.pipeline``."""

from strandline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
