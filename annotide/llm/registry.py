"""Registry of this package's queries and their SQL."""

from __future__ import annotations

from annotide.llm import queries as _queries


def queries() -> dict:
    return {name: f for name, f in vars(_queries).items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from annotide.llm import oracles

    return dict(oracles.SQL)
