"""All queries over the driver's tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from . import blocks, carriers, fingerprints, layers, more, texts  # noqa: F401
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
