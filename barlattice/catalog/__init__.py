"""All registered queries, grouped by family."""

from __future__ import annotations

import importlib

from barlattice.catalog.core import QUERIES, SQL, QueryFn

FAMILIES = [
    "quality", "shaping", "indicators", "signals", "execution", "ledger", "performance", "pnl", "risk", "exits", "attribution", "walkforward", "masks", "lake",

]


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"barlattice.catalog.{family}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
