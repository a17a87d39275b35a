"""Operators that look at one pixel at a time, or count pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spritespark.functions.color import clamp, luma

RGB, RGBA = ("r", "g", "b"), ("r", "g", "b", "a")


def transform_pixels(pixels: DataFrame, f: Callable[[dict[str, Column]], dict[str, Column]]) -> DataFrame:
    """A user's function from the channel columns to new ones, applied to every pixel inside the plan."""
    return pixels.withColumns(f({c: F.col(c) for c in RGBA if c in pixels.columns}))


def on_channels(pixels: DataFrame, f: Callable[[Column], Column], channels: tuple = RGB, mask: DataFrame | None = None, keys: tuple = ("image_id", "x", "y")) -> DataFrame:
    """f on the chosen channels; with a mask (a set of points), only on the pixels in it."""
    if mask is None:
        return pixels.withColumns({c: f(F.col(c)) for c in channels})
    inside = pixels.join(mask.select(*keys, F.lit(True).alias("__in")).distinct(), list(keys), "left")
    return inside.withColumns({c: F.when(F.col("__in"), f(F.col(c))).otherwise(F.col(c)) for c in channels}).drop("__in")


def invert(pixels: DataFrame, channels: tuple = RGB) -> DataFrame:
    return on_channels(pixels, lambda c: 255 - c, channels)


def brightness_contrast(pixels: DataFrame, brightness: float, contrast: float, channels: tuple = RGB) -> DataFrame:
    """clamp((c + 1)(x - 0.5) + 0.5) * (1 + b), clamped again, with x a channel in 0..1."""
    f = lambda c: F.floor(255.5 * clamp(clamp((1 + contrast) * (c / F.lit(255.0) - 0.5) + 0.5, 0.0, 1.0) * (1 + brightness), 0.0, 1.0)).cast("int")
    return on_channels(pixels, f, channels)


def curve_table(points: list[tuple[int, int]]) -> list[int]:
    """The 256 values of a piecewise linear curve through its points, flat before the first and after the last."""
    points = sorted(points)
    out = []
    for x in range(256):
        left = [p for p in points if p[0] <= x]
        right = [p for p in points if p[0] > x]
        if not left or not right:
            out.append((left[-1] if left else right[0])[1])
        else:
            (x0, y0), (x1, y1) = left[-1], right[0]
            out.append(max(0, min(255, int(y0 + (y1 - y0) * (x - x0) / (x1 - x0)))))
    return out


def color_curve(pixels: DataFrame, points: list[tuple[int, int]], channels: tuple = RGB) -> DataFrame:
    values = F.array(*map(F.lit, curve_table(points)))
    return on_channels(pixels, lambda c: F.element_at(values, c + 1), channels)


def near(color: dict[str, int], tolerance: int) -> Column:
    """Every given channel within the tolerance."""
    out = F.lit(True)
    for c, v in color.items():
        out = out & (F.abs(F.col(c) - v) <= tolerance)
    return out


def replace_color(pixels: DataFrame, old: dict[str, int], new: dict[str, int], tolerance: int = 0) -> DataFrame:
    hit = near(old, tolerance)
    return pixels.select(*(F.when(hit, F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pixels.columns))


def mask_by_color(pixels: DataFrame, color: dict[str, int], fuzziness: int, keys: tuple = ("image_id",)) -> DataFrame:
    return pixels.filter(near(color, fuzziness)).select(*keys, "x", "y")


def mask_from_alpha(pixels: DataFrame, threshold: int = 0, keys: tuple = ("image_id",)) -> DataFrame:
    return pixels.filter(F.col("a") > threshold).select(*keys, "x", "y")


def hue_saturation(pixels: DataFrame, hue: float = 0.0, saturation: float = 0.0, value: float = 0.0) -> DataFrame:
    """Shifts the hue by degrees and scales saturation and value by 1 + s and 1 + v; transparent pixels become 0."""
    from spritespark.functions.color import hue_value_saturation

    h, v, s = hue_value_saturation()
    out = pixels.withColumns({"__h": F.pmod(h + hue, F.lit(360.0)) / 60, "__v": clamp(v * (1 + value), 0.0, 1.0), "__s": clamp(s * (1 + saturation), 0.0, 1.0)})
    part = lambda n: F.col("__v") - F.col("__v") * F.col("__s") * F.greatest(F.lit(0.0), F.least(F.pmod(F.lit(float(n)) + F.col("__h"), F.lit(6.0)), 4 - F.pmod(F.lit(float(n)) + F.col("__h"), F.lit(6.0)), F.lit(1.0)))
    made = {c: F.when(F.col("a") == 0, 0).otherwise(F.floor(part(n) * 255 + 0.5 + 1e-9).cast("int")) for c, n in (("r", 5), ("g", 3), ("b", 1))}
    return out.withColumns(made).drop("__h", "__s", "__v")


def to_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", luma()).drop(*RGB)


def chroma_key(pixels: DataFrame, key: dict[str, int], reach: float) -> DataFrame:
    """Soft alpha by distance from the key colour, and no more of its strongest channel than of the others.

    Up to 0.45 of the reach a pixel is transparent, from 1.05 on opaque.
    """
    d = F.sqrt(sum(((F.col(c) - key[c]) * (F.col(c) - key[c]) for c in RGB), F.lit(0)).cast("double"))
    soft = clamp((d - 0.45 * reach) / (0.6 * reach), 0.0, 1.0)
    top = max(RGB, key=lambda c: key[c])
    others = [F.col(c) for c in RGB if c != top]
    return pixels.withColumns({"a": F.floor(F.col("a") * soft + 0.5).cast("int"), top: F.when(soft < 1, F.least(F.col(top), F.greatest(*others))).otherwise(F.col(top))})


# counts


def color_histogram(pixels: DataFrame, keys: tuple = ("image_id",), channels: tuple = RGBA) -> DataFrame:
    """Pixels of each visible colour; partial sums on each side of the shuffle take care of a hot background."""
    return pixels.filter("a > 0").groupBy(*keys, *channels).agg(F.count("*").alias("n"))


def binned_histogram(pixels: DataFrame, keys: tuple = ("image_id",), bits: tuple = (5, 6, 5, 5)) -> DataFrame:
    return pixels.select(*keys, *(F.shiftright(c, 8 - n).alias(c) for c, n in zip(RGBA, bits, strict=True))).groupBy(*keys, *RGBA).agg(F.count("*").alias("n"))


def top_colors(pixels: DataFrame, k: int, keys: tuple = ("image_id",)) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("n"), *RGBA)
    return color_histogram(pixels, keys).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def is_plain(pixels: DataFrame, keys: tuple = ("image_id",)) -> DataFrame:
    """Whether an image has one colour, and whether nothing of it is visible."""
    from spritespark.functions.color import pack_rgba

    return pixels.groupBy(*keys).agg((F.min(pack_rgba()) == F.max(pack_rgba())).alias("plain"), (F.max("a") == 0).alias("empty"))


def without_empty(items: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a visible pixel."""
    return items.join(pixels.filter("a > 0").select(*keys).distinct(), keys, "left_semi")


def bounds(pixels: DataFrame, keys: tuple) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))


def trim_bounds(pixels: DataFrame, keys: tuple = ("image_id",), ref: dict[str, int] | None = None) -> DataFrame:
    """The box of the pixels that differ from the reference colour; transparent pixels are all equal."""
    ref = ref or {"r": 0, "g": 0, "b": 0, "a": 0}
    if ref["a"] == 0:
        return bounds(pixels.filter("a > 0"), keys)
    return bounds(pixels.filter(~near(ref, 0)), keys)


def trim_color(pixels: DataFrame, width: int, height: int, keys: tuple = ("image_id",)) -> DataFrame:
    """(keys, color): the colour that trimming compares with, packed; 0 is transparent, null where two sides disagree.

    A transparent pixel on the top or bottom row decides; then a solid side's colour, the corner's of that side. A solid
    top and bottom (then: left and right) of different colours give none. All pixels of the image must be there.
    """
    from spritespark.functions.color import pack_rgba

    x, y, c = F.col("x"), F.col("y"), F.when(F.col("a") > 0, pack_rgba()).otherwise(F.lit(0))
    edge = pixels.filter((x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)).withColumn("__c", c)
    sides = {"t": y == 0, "b": y == height - 1, "l": x == 0, "r": x == width - 1}
    seen = edge.groupBy(*keys).agg(
        F.max(F.when((x == 0) & (y == 0), F.col("__c"))).alias("first"), F.max(F.when((x == width - 1) & (y == height - 1), F.col("__c"))).alias("last"),
        *(f(F.when(at, F.col("__c"))).alias(f"{k}_{n}") for k, at in sides.items() for n, f in (("low", F.min), ("high", F.max))),
    )
    clear = lambda a, b: F.least(f"{a}_low", f"{b}_low") == 0
    solid = lambda k: F.col(f"{k}_low") == F.col(f"{k}_high")
    apart = F.col("first") != F.col("last")
    second = (~solid("t") & solid("b")) | (~solid("l") & solid("r"))
    color = F.when(clear("t", "b"), F.lit(0)).when(solid("t") & solid("b") & apart, F.lit(None)).when(clear("l", "r"), F.lit(0)).when(solid("l") & solid("r") & apart, F.lit(None)).when(second, F.col("last")).otherwise(F.col("first"))
    return seen.select(*keys, color.cast("long").alias("color"))


def snap_out(boxes: DataFrame, gw: int, gh: int) -> DataFrame:
    """Boxes grown outwards to a grid's lines."""
    x, y = F.floor(F.col("x") / gw) * gw, F.floor(F.col("y") / gh) * gh
    x2, y2 = F.ceil((F.col("x") + F.col("w")) / gw) * gw, F.ceil((F.col("y") + F.col("h")) / gh) * gh
    return boxes.withColumns({"x": x.cast("int"), "y": y.cast("int"), "w": (x2 - x).cast("int"), "h": (y2 - y).cast("int")})


def image_diff_count(one: DataFrame, two: DataFrame, keys: tuple = ("image_id",), channels: tuple = RGBA) -> DataFrame:
    """Pixels that differ, -1 where the images do not cover the same points."""
    on = [*keys, "x", "y"]
    a = one.select(*on, *(F.col(c).alias(f"{c}1") for c in channels), F.lit(1).alias("in1"))
    b = two.select(*on, *(F.col(c).alias(f"{c}2") for c in channels), F.lit(1).alias("in2"))
    differ = F.lit(False)
    for c in channels:
        differ = differ | ~F.col(f"{c}1").eqNullSafe(F.col(f"{c}2"))
    each = a.join(b, on, "full")
    return each.groupBy(*keys).agg(F.when(F.count_if(F.col("in1").isNull() | F.col("in2").isNull()) > 0, -1).otherwise(F.count_if(differ)).alias("n"))


def frame_delta(pixels: DataFrame, keys: tuple = ("sprite_id",)) -> DataFrame:
    """The box of what changed since the frame before, and whether a pixel was cleared; the first frame's is the whole canvas.

    The canvas is what all the sprite's pixels, visible or not, cover from the origin. A frame without a change has no row.
    """
    on = [*keys, "frame", "x", "y"]
    from spritespark.functions.color import pack_rgba

    now = pixels.filter("a > 0").select(*on, pack_rgba().alias("c"))
    frames = pixels.select(*keys, "frame").distinct()
    before = now.withColumn("frame", F.col("frame") + 1).withColumnRenamed("c", "old").join(frames, [*keys, "frame"], "left_semi")
    changed = now.join(before, on, "full").filter(~F.col("c").eqNullSafe(F.col("old")))
    canvas = pixels.groupBy(*keys).agg(F.min("frame").alias("frame"), F.lit(0).alias("x"), F.lit(0).alias("y"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.lit(False).alias("cleared"))
    later = changed.join(canvas.select(*keys, "frame"), [*keys, "frame"], "left_anti")
    boxes = later.groupBy(*keys, "frame").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.bool_or(F.col("c").isNull()).alias("cleared"))
    return canvas.unionByName(boxes)


def flicker(indexed: DataFrame, keys: tuple = ("sprite_id",)) -> DataFrame:
    """Per frame: sum of |change| of each colour of the frame before, over that frame's pixels."""
    hist = indexed.groupBy(*keys, "frame", "idx").agg(F.count("*").alias("n"))
    now = hist.withColumn("frame", F.col("frame") - 1).withColumnRenamed("n", "m")
    frames = now.select(*keys, "frame").distinct()
    pairs = hist.join(frames, [*keys, "frame"], "left_semi").join(now, [*keys, "frame", "idx"], "left")
    return pairs.groupBy(*keys, (F.col("frame") + 1).alias("frame")).agg((F.sum(F.abs(F.col("n") - F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("delta"))
