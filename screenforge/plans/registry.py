"""Collects the queries of all plan modules with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(spark, sf)``; doubles are rounded to ``digits`` on both sides.

    ``doubles`` names the double columns of the SQL text, which gets the same rounding.
    """
    from screenforge.plans.tables import cut_shift, rounded

    def wrap(fn):
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None and doubles:
            cols = ", ".join(
                f"ROUND(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END + {cut_shift(digits)!r}, {digits}) AS {c}"
                for c in doubles.split()
            )
            SQL[name] = f"SELECT * REPLACE ({cols}) FROM ({sql})"
        elif sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> None:
    import importlib
    import pkgutil

    import screenforge.plans as plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__)):
        if m not in ("registry", "tables"):
            importlib.import_module(f"screenforge.plans.{m}")
