"""Joins of rows whose number Spark can't tell beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rows of a broadcast side that isn't a palette.
FEW = 10_000


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join, which is then by shuffle.

    Rows that an explode makes, or that are read from a table that packs well, pass for as small as the text or the file
    that they come from: Spark would gather pixels on the driver to broadcast them.
    """
    return rows.hint("merge")


def few(rows: DataFrame) -> DataFrame:
    """A side that is broadcast where it has few rows, which are counted; beyond that the join is by shuffle.

    Spark doesn't know the size of rows that come from Python, and would broadcast the other side.
    """
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else shuffled(rows)
