"""Queries over the given tables, grouped by job."""

from . import acceptance, alarms, evals, fleet, ingest, logs, maps, model, router, routes  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
