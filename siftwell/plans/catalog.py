"""All queries of the library by name, each with its SQL."""

from __future__ import annotations

from siftwell.plans import (  # noqa: F401  (importing registers)
    aggregates,
    browse,
    identity,
    joins,
    ranking,
    reconcile,
    registry,
    resolution,
    retrieval,
    rules,
    sampling,
    sets,
    sources,
    streams,
)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracles() -> dict[str, str]:
    return registry.ORACLES
