"""Registered queries over a folder of tables, with their SQL."""

from trailwork.plans import hunting, ingest, measures, more, shapes  # noqa: F401  they register themselves
from trailwork.plans.base import ORACLES, QUERIES, Tables  # noqa: F401
