"""Registries of worlds, verifiers and policies by name, with entry points of installed packages."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

_MADE: dict[str, dict[str, Callable[..., Any]]] = {}


def register(kind: str, name: str, factory: Callable[..., Any]) -> None:
    """A later registration of a name replaces the earlier one."""
    _MADE.setdefault(kind, {})[name] = factory


def names(kind: str) -> list[str]:
    return sorted({*_MADE.get(kind, {}), *(e.name for e in entry_points(group=f"tracewright.{kind}"))})


def create(kind: str, name: str, *args: Any, **options: Any) -> Any:
    """Make one by name; registered ones come before entry points."""
    if name in _MADE.get(kind, {}):
        return _MADE[kind][name](*args, **options)
    for entry in entry_points(group=f"tracewright.{kind}"):
        if entry.name == name:
            return entry.load()(*args, **options)
    raise KeyError(f"no {kind} named {name!r}; there are {names(kind)}")
