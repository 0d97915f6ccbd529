"""All registered queries; importing the plan modules fills the registry."""

from runlens.plans import diagnosis, ingest, runs, statistics, steps  # noqa: F401
from runlens.plans.registry import oracles, queries

__all__ = ["queries", "oracles"]
