"""Named queries over the operators, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

# Order matters: later modules build on SQL blocks of earlier ones.
from tandemtape.plans import frames, prices, models, quality, campaigns, streams  # noqa: F401, I001
from tandemtape.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
