"""All queries of the sprite operators, by name, and their SQL oracles."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spritespark import queries as _queries
from spritespark.queries.registry import ORACLES, QUERIES

FLAGSHIP = "sheet_export"

for _module in sorted(m.name for m in pkgutil.iter_modules(_queries.__path__)):
    importlib.import_module(f"{_queries.__name__}.{_module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
