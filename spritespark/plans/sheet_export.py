"""The batch export of sprite sheets: composite, trim, merge duplicates, lay out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spritespark.operators.neighbors import flatten
from spritespark.operators.sheets import content_sums
from spritespark.operators.structure import render_order


def export_sheet(cels: DataFrame, pixels: DataFrame, per_row: int = 3, padding: int = 1) -> DataFrame:
    """(sprite_id, frame, original, x, y, w, h): the slot of every frame on its sprite's sheet.

    cels: sprite_id, frame, layer, z, opacity, mode; pixels: sprite_id, frame, layer, x, y, r, g, b, a.
    Frames of equal content share the slot of the first. Pixels are composited once and reduced to one row a frame; all
    that follows is windows within a sprite, which share one partitioning, and no join.
    """
    keys = ["sprite_id", "frame"]
    flat = flatten(pixels.join(render_order(cels, keys), [*keys, "layer"]))
    image = Window.partitionBy(*keys)
    moved = flat.withColumns({"bx": F.min("x").over(image), "by": F.min("y").over(image)}).withColumns({"x": F.col("x") - F.col("bx"), "y": F.col("y") - F.col("by")})
    items = moved.groupBy(*keys).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), content_sums().alias("hash"))
    sprite = Window.partitionBy("sprite_id")
    same = Window.partitionBy("sprite_id", "hash")
    out = items.withColumn("original", F.min("frame").over(same)).withColumn("own", F.col("frame") == F.col("original"))
    out = out.withColumn("band", F.floor((F.sum(F.col("own").cast("int")).over(sprite.orderBy("frame")) - 1) / per_row))
    band = Window.partitionBy("sprite_id", "band")
    before = Window.unboundedPreceding, -1
    out = out.withColumns({"along": F.coalesce(F.sum(F.when(F.col("own"), F.col("w") + padding)).over(band.orderBy("frame").rowsBetween(*before)), F.lit(0)), "most": F.max(F.when(F.col("own"), F.col("h") + padding)).over(band), "lead": F.row_number().over(band.orderBy(F.desc("own"), "frame")) == 1})
    out = out.withColumn("across", F.sum(F.when(F.col("lead"), F.col("most"))).over(sprite.orderBy("band").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most"))
    slot = lambda c: F.max(F.when(F.col("own"), F.col(c))).over(same)
    return out.select(*keys, "original", slot("along").alias("x"), slot("across").alias("y"), "w", "h")
