"""What the driver's entry point adds when this subpackage is present."""

from assaykit.llm.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
