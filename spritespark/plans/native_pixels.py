"""From enlarged, blurred or keyed pictures back to native pixel art: key, grid, cells, palette, clean-up, and a report an animation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spritespark.functions.color import oklab
from spritespark.operators import grids, grouped, neighbors
from spritespark.operators.joins import shuffled
from spritespark.operators.points import flicker
from spritespark.sources.files import stored

SPRITE, FRAME = ["sprite_id"], ["sprite_id", "frame"]


def key_colors(frames: DataFrame, least: float = 0.30, spread: int = 60, bin_: int = 24) -> DataFrame:
    """(sprite_id, kr, kg, kb): the most frequent colour, in bins, of the border of each animation's first frame, where it has a hue and enough of it."""
    first = shuffled(frames).join(frames.groupBy(*SPRITE).agg(F.min("frame").alias("frame")), FRAME)
    size = first.groupBy(*SPRITE).agg(*(F.expr(f"{f}({c})").alias(f"{f}_{c}") for c in "xy" for f in ("min", "max")))
    edge = shuffled(first).join(size, SPRITE).filter("x IN (min_x, max_x) OR y IN (min_y, max_y)")
    counts = edge.groupBy(*SPRITE, *((F.floor(F.col(c) / bin_) * bin_).cast("int").alias(f"k{c}") for c in "rgb")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgb"))
    top = counts.groupBy(*SPRITE).agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), "kr", "kg", "kb", "n", *"rgb")).alias("t"))
    mean = [F.floor(F.col(f"t.{c}") / F.col("t.n")).cast("int").alias(f"k{c}") for c in "rgb"]
    return top.filter((F.col("t.n") > least * F.col("all")) & (F.greatest("t.kr", "t.kg", "t.kb") - F.least("t.kr", "t.kg", "t.kb") > spread)).select(*SPRITE, *mean)


def keyed(frames: DataFrame, keys: DataFrame, reach: float = 90.0) -> DataFrame:
    """Soft alpha by the distance from each animation's own key colour, and no more of its strongest channel than of the others."""
    at = frames.join(keys, SPRITE, "left")
    d = F.sqrt(sum((F.col(c) - F.col(f"k{c}")) * (F.col(c) - F.col(f"k{c}")) for c in "rgb").cast("double"))
    soft = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - 0.45 * reach) / (0.6 * reach))), F.lit(1.0))
    top = F.greatest("kr", "kg", "kb")
    leads = {"r": F.col("kr") == top, "g": (F.col("kg") == top) & (F.col("kr") < top), "b": (F.col("kb") == top) & (F.col("kr") < top) & (F.col("kg") < top)}
    less = lambda c: F.least(F.col(c), F.greatest(*(F.col(o) for o in "rgb" if o != c)))
    return at.select(*FRAME, "x", "y", *(F.when((soft < 1) & leads[c], less(c)).otherwise(F.col(c)).alias(c) for c in "rgb"), F.floor(F.col("a") * soft + 0.5).cast("int").alias("a"))


def first_grids(frames: DataFrame, refine: tuple = ()) -> DataFrame:
    """(sprite_id, pitch_x, pitch_y, phase_x, phase_y): the grid of each animation's first frame on white; refined by compactness, if rounds are given."""
    first = shuffled(frames).join(frames.groupBy(*SPRITE).agg(F.min("frame").alias("frame")), FRAME)
    white = first.withColumn("v", F.floor((F.col("r") + F.col("g") + F.col("b")) / 3 * F.col("a") / 255 + 255 - F.col("a")).cast("int"))
    found = stored(grids.native_grid(neighbors.edge_signal(white, "v", tuple(SPRITE)), keys=tuple(SPRITE)), "grids")
    return grids.refined_grid(first, found, refine, tuple(SPRITE)) if refine else found.drop("fit")


def shared_palettes(cells: DataFrame, colors: int, least: int = 3, radius: float = 10.0) -> DataFrame:
    """(sprite_id, idx, r, g, b): the recurrent colours of all frames of an animation, the most frequent ``colors`` of them."""
    counts = cells.groupBy(*SPRITE, *"rgb").agg(F.count("*").alias("n"))
    return grouped.recurrent_palette(counts, least, radius).filter(F.col("idx") < colors).select(*SPRITE, "idx", *"rgb")


def snapped(cells: DataFrame, palettes: DataFrame) -> DataFrame:
    """cells with idx and delta, the nearest entry of their own animation's palette in OKLab; each distinct colour of an animation is compared once."""
    lab = lambda df, names: df.withColumns(dict(zip(names, oklab(), strict=True)))
    entries = lab(palettes, ("pl", "pa", "pb")).select(*SPRITE, "idx", "pl", "pa", "pb")
    kinds = lab(cells.select(*SPRITE, *"rgb").distinct(), ("cl", "ca", "cb"))
    d = F.sqrt(sum((F.col(f"c{k}") - F.col(f"p{k}")) * (F.col(f"c{k}") - F.col(f"p{k}")) for k in "lab"))
    best = shuffled(kinds).join(entries, SPRITE).groupBy(*SPRITE, *"rgb").agg(F.min(F.struct(F.round(d, 9).alias("delta"), "idx")).alias("m"))
    return shuffled(cells).join(best.select(*SPRITE, *"rgb", "m.idx", "m.delta"), [*SPRITE, *"rgb"])


def native_frames(frames: DataFrame, colors: int = 32, reach: float = 90.0, refine: tuple = (), passes: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, palettes, grids): frames (sprite_id, frame, x, y, r, g, b, a) as native cells (..., u, w, idx, delta, own: the index
    before ``passes`` of orphan removal), each animation's palette and its grid."""
    clear = stored(keyed(frames, key_colors(frames), reach), "keyed")
    found = stored(first_grids(clear, refine), "grids")
    by_frame = found.join(clear.select(*FRAME).distinct(), SPRITE)
    cells = stored(grids.native_cells(clear, by_frame, keys=tuple(FRAME)), "cells")
    palettes = stored(shared_palettes(cells, colors), "palettes")
    out = snapped(cells, palettes).withColumn("own", F.col("idx"))
    if passes:
        at = stored(out.withColumnsRenamed({"u": "x", "w": "y"}), "snapped")
        out = neighbors.remove_orphans(at, 0, 0, "idx", tuple(FRAME), passes).withColumnsRenamed({"x": "u", "y": "w"})
    return stored(out, "native"), palettes, found


def native_report(frames: DataFrame, **options) -> DataFrame:
    """One row an animation: grid, native size, cells, colours before and after, mean distance to the palette, orphans removed, mean flicker."""
    cells, palettes, found = native_frames(frames, **options)
    sums = cells.groupBy(*SPRITE).agg(
        F.count_distinct("frame").alias("frames"), (F.max("u") - F.min("u") + 1).alias("width"), (F.max("w") - F.min("w") + 1).alias("height"), F.count("*").alias("cells"),
        F.count_distinct(*"rgb").alias("colors"), F.round(F.avg("delta"), 6).alias("delta"), F.sum((F.col("idx") != F.col("own")).cast("int")).alias("orphans"),
    )
    sizes = palettes.groupBy(*SPRITE).agg(F.count("*").alias("palette"))
    moving = flicker(cells.select(*FRAME, "idx")).groupBy(*SPRITE).agg(F.round(F.avg("delta"), 6).alias("flicker"))
    return sums.join(sizes, SPRITE, "left").join(moving, SPRITE, "left").join(found.select(*SPRITE, *grids.GRID), SPRITE, "left")
