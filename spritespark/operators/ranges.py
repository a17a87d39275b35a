"""Numbers and running totals in groups of any size: rows are dealt out in ranges, ordered inside each, and a few rows a range carry the totals on.

No task holds a group; what meets in one window is one row for each range that a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spritespark.sources.files import stored


def numbered(rows: DataFrame, keys: list[str], order: list[str], value: Column | None = None) -> DataFrame:
    """rows with ``number``, their place in their group from 0, and with ``before``, the sum of ``value`` over the rows before them.

    order must tell the rows of a group apart; null values count as 0.
    """
    own = rows.withColumn("__value", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0))
    ranged = stored(own.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_from") for c in ("__n", "__sum")))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    out = ranged.withColumns({"__at": F.row_number().over(inside) - 1, "__own": F.coalesce(F.sum("__value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    out = out.join(starts, [*keys, "__range"]).withColumns({"number": F.col("__at") + F.col("__n_from"), "before": F.col("__own") + F.col("__sum_from")})
    return out.select(*rows.columns, "number", *(["before"] if value is not None else []))


def long_line(samples: DataFrame, vertical: bool = False, border: int = 0, padding: int = 0, sheet: str = "sheet", order: str = "item") -> DataFrame:
    """``sheets.layout_line`` for sheets of very many samples: each lies after the sizes of those before it."""
    out = numbered(samples, [sheet], [order], F.col("h" if vertical else "w") + padding)
    at = F.col("before") + border
    return out.withColumns({"x": F.lit(border) if vertical else at, "y": at if vertical else F.lit(border)}).drop("number", "before")
