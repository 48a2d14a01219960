"""All queries on the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Query

MODULES = (
    "plans.track_metrics",
    "operators.windows",
    "operators.ordering",
    "operators.aggregates",
    "operators.joins",
    "operators.near_tracks",
    "operators.selection",
    "functions.scalars",
    "functions.geometry",
    "functions.udfs",
    "functions.chunks",
    "functions.student",
    "plans.schedules",
    "plans.pairing",
    "plans.cursors",
    "streaming.live",
    "streaming.state",
    "sources.files",
    "sources.formats",
    "sources.plugins",
    "sources.tail",
    "sources.ranges",
    "sources.records",
    "sources.shard_stream",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f".{name}", __package__)


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
