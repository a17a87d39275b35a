"""Conversion between RGB, gray and indexed pixels, all nine pairs, with the rules of the mask index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spritespark.functions.color import luma
from spritespark.operators.lookups import nearest_palette, weighted_distance
from spritespark.operators.palettes import small_palette

CHANNELS = {"rgb": ("r", "g", "b", "a"), "gray": ("v", "a"), "indexed": ("idx",)}


def converted(pixels: DataFrame, source: str, target: str, palette: DataFrame | None = None, mask_index: int = 0, new_palette: DataFrame | None = None, new_mask: int = 0, background: bool = False) -> DataFrame:
    """pixels with the channels of ``source`` (r, g, b, a; v, a; or idx) in place of which they get those of ``target``.

    palette: what a source's indexes stand for, idx, r, g, b, a; the mask index is transparent black, but on a background layer, whose pixels are
    all opaque in RGB. new_palette: what colours become indexed with; nearly transparent ones take its mask index, which no other colour does.
    """
    own = [c for c in pixels.columns if c not in CHANNELS[source]]
    if source == target != "indexed":
        return pixels
    out = pixels
    if source == "gray":
        out = out.select(*own, *(F.col("v").alias(c) for c in "rgb"), "a")
    elif source == "indexed":
        out = out.join(small_palette(palette.select("idx", *"rgba")), "idx", "left")
        masked = F.lit(False) if background else F.col("idx") == mask_index
        opaque = background and target == "rgb"
        out = out.select(*own, *(F.when(masked, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in "rgb"), F.when(masked, 0).otherwise(F.lit(255) if opaque else F.coalesce("a", F.lit(0))).alias("a"))
    if target == "rgb":
        return out
    if target == "gray":
        return out.select(*own, luma().cast("int").alias("v"), "a")
    entries = new_palette.filter(F.col("idx") != new_mask).select("idx", *(F.col(c).alias(f"p{c}") for c in "rgba"))
    small_palette(entries)
    near = nearest_palette(out.filter(F.shiftright("a", 3) > 0), entries, weighted_distance()).drop("distance")
    return out.join(near, list("rgba"), "left").select(*own, F.coalesce("idx", F.lit(new_mask)).cast("int").alias("idx"))
