from bookloom.plans.registry import ORACLES, QUERIES
from bookloom.plans import columns, text, matching, lookups, reports, ordering, webpages, sources, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
