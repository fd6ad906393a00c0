"""All queries over the standard tables, and their SQL."""

from __future__ import annotations

from .plans import base
from .plans import cohort, companion, metrics, network, normalisation, screens, sequence  # noqa: F401  (they register queries)
from .plans import ingest, learning, survival, streams  # noqa: F401


def queries() -> dict:
    return base.QUERIES


def oracles() -> dict:
    return base.ORACLES
