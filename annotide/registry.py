"""Registry of the core queries and their SQL: each module of ``annotide.plans`` holds QUERIES and SQL."""

from __future__ import annotations

import importlib
import pkgutil

from annotide import plans


def _modules() -> list:
    return [importlib.import_module(f"{plans.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _modules() for name, text in module.SQL.items()}
