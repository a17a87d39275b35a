"""As-of, interval and equality joins between sprites' tables, and nearest-colour search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spritespark.operators.joins import shuffled


def palette_lookup(indexed: DataFrame, palette: DataFrame, keys: tuple = (), mask_index: int = 0, background: bool = False) -> DataFrame:
    """Indexed pixels as RGBA: the mask index is transparent black unless on a background layer, which is opaque.

    The palette has at most 256 rows for each value of keys; it is broadcast by Spark where its size allows.
    """
    out = indexed.join(F.broadcast(palette) if not keys else palette, [*keys, "idx"])  # without keys: 256 rows
    if background:
        return out.withColumn("a", F.lit(255))
    hidden = F.col("idx") == mask_index
    return out.withColumns({c: F.when(hidden, 0).otherwise(F.col(c)) for c in "rgba"})


def as_of(rows: DataFrame, keyed: DataFrame, keys: list[str], at: str = "frame", since: str = "frame_from", kind: str = "left") -> DataFrame:
    """The key in force: the last with since <= at. One window over both sides' points finds it, so that no pair is made in vain."""
    starts = keyed.select(*keys, F.col(since).alias(at), F.col(since).alias("__since"), F.lit(0).alias("__asked")).distinct()
    asked = rows.select(*keys, at).distinct().withColumns({"__since": F.lit(None), "__asked": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy(at, "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(asked).withColumn(since, F.last("__since", ignorenulls=True).over(w))
    spans = found.filter((F.col("__asked") == 1) & F.col(since).isNotNull()).select(*keys, at, since)
    return rows.join(spans, [*keys, at], kind).join(keyed, [*keys, since], kind)


def innermost_tags(frames: DataFrame, tags: DataFrame, keys: list[str], outer: bool = False) -> DataFrame:
    """Each frame's shortest (outer: longest) tag; the first in tag order where several are as long."""
    hit = frames.select(*keys, "frame").distinct().join(tags, keys).filter("frame BETWEEN from_frame AND to_frame")
    size = F.col("to_frame") - F.col("from_frame")
    return hit.groupBy(*keys, "frame").agg(F.min_by("tag_id", F.struct((-size if outer else size).alias("n"), "from_frame", "tag_id")).alias("tag_id"))


def linked_cels(cels: DataFrame, keys: list[str]) -> DataFrame:
    """Cels with the first frame that shows the same data, and how many do."""
    w = cels.groupBy(*keys, "data_id").agg(F.min("frame").alias("origin"), F.count("*").alias("links"))
    return cels.join(w, [*keys, "data_id"])


def pick_cels(points: DataFrame, pixels: DataFrame, threshold: int = 1) -> DataFrame:
    """The front-most opaque pixel under each point: points sprite_id, point_id, x, y; pixels sprite_id, z, x, y, a."""
    hit = points.join(shuffled(pixels.filter(F.col("a") >= threshold)), ["sprite_id", "x", "y"])
    return hit.groupBy("point_id").agg(F.max("z").alias("z"))


def pick_cels_by_bounds(points: DataFrame, pixels: DataFrame, threshold: int = 1, cell: int = 32, keys: tuple = ("sprite_id", "z")) -> DataFrame:
    """``pick_cels`` by the cels' bounds: points meet the cels of their square of ``cell`` pixels, only then the pixels."""
    box = pixels.groupBy(*keys).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    over = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}1") / cell), F.floor(F.col(f"{c}2") / cell)))
    squares = box.withColumn("i", over("x")).withColumn("j", over("y"))
    at = points.withColumns({"i": F.floor(F.col("x") / cell), "j": F.floor(F.col("y") / cell)})
    under = shuffled(at).join(squares, [k for k in keys if k != "z"] + ["i", "j"]).filter("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2").select("point_id", *keys, "x", "y")
    return under.join(shuffled(pixels.filter(F.col("a") >= threshold).select(*keys, "x", "y")), [*keys, "x", "y"]).groupBy("point_id").agg(F.max("z").alias("z"))


def nearest_palette(colors: DataFrame, palette: DataFrame, distance: Column, keys: tuple = ("r", "g", "b", "a")) -> DataFrame:
    """(keys, idx, distance) for the distinct colours; the first of the nearest entries wins.

    palette: columns idx, pr, pg, pb, pa, at most 256 rows, broadcast. distance: over both sides' channels.
    """
    pairs = colors.select(*keys).distinct().join(F.broadcast(palette), how="cross")  # at most 256 rows, for each distinct colour
    return pairs.groupBy(*keys).agg(F.min(F.struct(distance.alias("d"), F.col("idx"))).alias("m")).select(*keys, F.col("m.idx").alias("idx"), F.col("m.d").alias("distance"))


def weighted_distance() -> Column:
    """Channels without their low 3 bits, weights 30, 59, 11 and 8, squared."""
    part = lambda c, w: F.pow(F.shiftright(c, 3) - F.shiftright(f"p{c}", 3), F.lit(2)) * (w * w)
    return (part("r", 30) + part("g", 59) + part("b", 11) + part("a", 8)).cast("long")


def dither_pairs(colors: DataFrame, palette: DataFrame, most: int, mask_index: int) -> DataFrame:
    """(r, g, b, a, idx, other, mix) for the distinct visible colours: the nearest entry, and that which mixes best with it.

    mix: how many of ``most`` parts the other entry has, from the channels by their weights in luma. Its distance counts
    the mixed colour's, and a tenth of that between both entries. palette: idx, r, g, b, a, at most 256 rows, broadcast.
    """
    entries = palette.filter(F.col("idx") != mask_index)
    side = lambda k: entries.select(F.col("idx").alias({0: "idx", 1: "other"}[k]), *(F.col(c).alias(f"{c}{k}") for c in "rgba"))
    near = nearest_palette(colors.filter("a > 0"), entries.select("idx", *(F.col(c).alias(f"p{c}") for c in "rgba")), weighted_distance()).drop("distance")
    pairs = near.join(F.broadcast(side(0)), "idx").join(F.broadcast(side(1)), how="cross")  # at most 256 rows, for each distinct colour
    weights = {"r": 2126, "g": 7152, "b": 722, "a": 20000}
    used = {c: "a1 <> a0" if c == "a" else f"a0 > 0 AND a1 > 0 AND {c}1 <> {c}0" for c in "rgba"}
    total = " + ".join(f"CASE WHEN {used[c]} THEN {w * most} * ({c} - {c}0) div ({c}1 - {c}0) ELSE 0 END" for c, w in weights.items())
    parts = " + ".join(f"CASE WHEN {used[c]} THEN {w} ELSE 0 END" for c, w in weights.items())
    pairs = pairs.withColumn("mix", F.expr(f"greatest(0, least({most}, coalesce(({total}) div nullif({parts}, 0), 0)))"))
    pairs = pairs.withColumns({f"{c}m": F.expr(f"{c}0 + ({c}1 - {c}0) * mix div {most}") for c in "rgba"})
    apart = lambda x, y: f"(CASE WHEN a{x} > 0 AND a{y} > 0 THEN abs(r{x} - r{y}) * 2126 + abs(g{x} - g{y}) * 7152 + abs(b{x} - b{y}) * 722 ELSE 0 END + abs(a{x} - a{y}) * 20000)"
    pairs = pairs.withColumn("d", F.expr(f"{apart('', 'm')} + {apart('0', '1')} div 10"))
    return pairs.groupBy(*"rgba", "idx").agg(F.min(F.struct("d", "other", "mix")).alias("m")).select(*"rgba", "idx", "m.other", "m.mix")


def to_indexed(pixels: DataFrame, palette: DataFrame, mask_index: int) -> DataFrame:
    """Pixels with idx in place of their channels: transparent ones the mask index, else an equal entry, else the nearest.

    palette: idx, r, g, b, a, at most 256 rows, broadcast; the first of equal entries wins, the mask index is none.
    """
    entries = palette.filter(F.col("idx") != mask_index)
    equal = entries.groupBy(*"rgba").agg(F.min("idx").alias("__equal"))
    near = nearest_palette(pixels.filter("a > 0"), entries.select("idx", *(F.col(c).alias(f"p{c}") for c in "rgba")), weighted_distance())
    colors = near.join(F.broadcast(equal), list("rgba"), "left").select(*"rgba", F.coalesce("__equal", "idx").alias("idx"))
    return pixels.join(colors, list("rgba"), "left").withColumn("idx", F.coalesce("idx", F.lit(mask_index))).drop(*"rgba")


def used_entries(palette: DataFrame, pixels: DataFrame, keys: list[str], used: bool = True) -> DataFrame:
    """Palette entries (or tiles) that pixels (or cells) refer to, or those that none does."""
    return palette.join(pixels.select(*keys).distinct(), keys, "left_semi" if used else "left_anti")


def table_diff(one: DataFrame, two: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): rows that were added, removed or changed between two tables."""
    a, b = one.select(*keys, F.struct(*values).alias("__a")), two.select(*keys, F.struct(*values).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, keys, "full").withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def palette_differences(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Count, first and last index of the entries that differ; the flags are of the first palette."""
    pair = one.join(two.select(*keys, "idx", *(F.col(c).alias(f"{c}2") for c in "rgba")), [*keys, "idx"], "full")
    differ = F.lit(False)
    for c in "rgba":
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"{c}2"))
    at = F.when(differ, F.col("idx"))
    return pair.groupBy(*keys).agg(F.count(at).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.bool_or(F.col("a") < 255).alias("has_alpha"), F.bool_or((F.col("a") > 0) & (F.col("a") < 255)).alias("has_semi_alpha"), F.bool_and((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)).alias("all_black"))


def merge_palettes(palettes: DataFrame, keys: list[str], order: list[str], most: int = 256) -> DataFrame:
    """New colours appended in order of first appearance, up to a palette's size."""
    first = palettes.groupBy(*keys, *"rgba").agg(F.min(F.struct(*order)).alias("__o"))
    w = Window.partitionBy(*keys).orderBy("__o")
    return first.withColumn("idx", F.row_number().over(w) - 1).filter(F.col("idx") < most).drop("__o")


def sprite_differences(levels: dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]], sprite: str = "sprite_id") -> DataFrame:
    """(level, sprite, added, removed, changed) of all levels in which two corpora differ; a level: two tables, keys, values."""
    out = None
    for level, (one, two, keys, values) in levels.items():
        n = table_diff(one, two, keys, values).groupBy(sprite).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed"))).select(F.lit(level).alias("level"), sprite, "added", "removed", "changed")
        out = n if out is None else out.union(n)
    return out


def invertible(remap: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys, invertible): whether no two sources have the same target."""
    return remap.groupBy(*keys).agg((F.count_distinct("dst") == F.count("*")).alias("invertible"))


def compose_remaps(first: DataFrame, then: DataFrame, keys: tuple = ()) -> DataFrame:
    """A remap (keys, src, dst) after another one; what the second does not name stays."""
    return first.join(shuffled(then.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("__to"))), [*keys, "dst"], "left").select(*keys, "src", F.coalesce("__to", "dst").alias("dst"))


def invert_remap(remap: DataFrame, keys: tuple = ()) -> DataFrame:
    """dst -> src, the first source winning."""
    return remap.groupBy(*keys, F.col("dst").alias("__to")).agg(F.min("src").alias("dst")).withColumnRenamed("__to", "src")
