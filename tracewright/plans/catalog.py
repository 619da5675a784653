"""The registered queries of the engine's own operators, each with its SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries; each has ``QUERIES`` and ``ORACLES``.
MODULES: tuple[str, ...] = ("leaderboards", "metrics", "reliability", "similarity", "boards", "mining", "trajectories", "worlds", "runs", "imports", "authoring", "tools")


def _loaded() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _loaded() for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _loaded() for name, sql in module.ORACLES.items()}
