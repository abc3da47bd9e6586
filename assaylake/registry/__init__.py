"""Registered queries over the given tables and their SQL twins."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

from .frames import ORACLE, QUERIES

_MODULES = ["cleaning", "sampling", "agebins", "domain", "evaluation", "uncertainty", "flows"]


def _load() -> None:
    for name in _MODULES:
        if find_spec(f"{__name__}.{name}") is None:
            continue
        import_module(f"{__name__}.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
