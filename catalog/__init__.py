"""Registered queries on the driver's tables, each next to DuckDB SQL written for the same question."""
from __future__ import annotations

from . import common


def load():
    """Imports every query module and returns the filled registry."""
    from . import audits, core, portfolios, reports, vendors, storage, markets, extension  # noqa: F401
    return common
