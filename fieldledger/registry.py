"""All queries of the engine itself."""

from fieldledger.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
