"""Layer trees, frames and playback, palettes in order, selections and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spritespark.sources.files import stored

#: A level is stored after so many joins, which keeps the plans of deep trees short.
STORED_EVERY = 8


def layer_paths(layers: DataFrame) -> DataFrame:
    """(layer_id, level, name, path, shown): one join a level up to the deepest; shown where all parents are visible.

    layers: layer_id, parent_id, level, name, visible.
    """
    out = layers.filter("parent_id IS NULL").select("layer_id", "level", "name", F.col("name").alias("path"), F.col("visible").alias("shown"))
    level = out
    lowest, deepest = layers.agg(F.min("level"), F.max("level")).first()
    for step in range(1, (deepest or 0) - (lowest or 0) + 1):
        up = level.select(F.col("layer_id").alias("parent_id"), F.col("path").alias("__p"), F.col("shown").alias("__s"))
        level = layers.join(up, "parent_id").select("layer_id", "level", "name", F.concat_ws("/", "__p", "name").alias("path"), (F.col("visible") & F.col("__s")).alias("shown"))
        if step % STORED_EVERY == 0:
            level = stored(level, "layers")
        out = out.union(level)
    return out


def matches_glob(path: str, glob: str, exclude: bool = False):
    """Segment by segment: * stands for one whole segment, and a trailing * for everything below.

    To exclude, a glob also covers all below it, and g/* the group g itself.
    """
    p, g = F.split(path, "/"), glob.split("/")
    ok = F.lit(True)
    for i, s in enumerate(g):
        if s != "*":
            ok = ok & (F.get(p, F.lit(i)) == s)
    least = len(g) - 1 if exclude and g[-1] == "*" and len(g) > 1 else len(g)
    return F.coalesce(ok & (F.size(p) >= least if exclude or g[-1] == "*" else F.size(p) == least), F.lit(False))


def resolved(layers: DataFrame, globs: list[str]) -> list[str]:
    """The globs, a bare name that only one layer has being its path. At most a row for each glob reaches the driver."""
    bare = [g for g in globs if "/" not in g and g != "*"]
    one = layers.filter(F.col("name").isin(bare)).groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").collect() if bare else []
    paths = {r["name"]: r["path"] for r in one}
    return [paths.get(g, g) for g in globs]


def filter_layers(layers: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """layers with path and shown: those that match an include (without any: the shown ones), less the excluded."""
    some = F.col("shown")
    include, exclude = resolved(layers, list(include)), resolved(layers, list(exclude))
    if include:
        some = F.lit(False)
        for g in include:
            some = some | matches_glob("path", g)
    for g in exclude:
        some = some & ~matches_glob("path", g, exclude=True)
    return layers.filter(some)


def select_frames(frames: DataFrame, tags: DataFrame, tag_id: int, first: int, last: int) -> DataFrame:
    """Frames first..last of a tag, counted from its start and kept inside it."""
    t = tags.filter(F.col("tag_id") == tag_id).select("sprite_id", F.greatest("from_frame", F.col("from_frame") + first).alias("lo"), F.least("to_frame", F.col("from_frame") + last).alias("hi"))
    return frames.join(t, "sprite_id").filter("frame BETWEEN lo AND hi").drop("lo", "hi")


def frame_times(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("sprite_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(w), F.lit(0)))


def frame_ranges(frames: DataFrame, key: str = "sprite_id") -> DataFrame:
    """Frames as runs of consecutive numbers."""
    island = F.col("frame") - F.row_number().over(Window.partitionBy(key).orderBy("frame"))
    return frames.withColumn("__i", island).groupBy(key, "__i").agg(F.min("frame").alias("from_frame"), F.max("frame").alias("to_frame")).drop("__i")


def play(tags: DataFrame) -> DataFrame:
    """The frames that each tag shows, in order: 0 forward, 1 reverse, 2 ping-pong, 3 ping-pong from the end.

    rep times, once where it is 0; a ping-pong's passes count each, without a number it goes there and back. It shows
    its turning frames once.
    """
    there, back = F.expr("sequence(from_frame, to_frame)"), F.expr("sequence(to_frame, from_frame, -1)")
    inner = lambda a: F.when(F.size(a) > 1, F.slice(a, 2, F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    tail = F.when(F.col("dir") % 2 == 0, inner(back)).otherwise(inner(there))
    head = F.when(F.col("dir") % 2 == 0, there).otherwise(back)
    n = F.when((F.col("rep") == 0) & (F.col("dir") >= 2), 2).otherwise(F.greatest(F.lit(1), F.col("rep")))
    once = F.when(F.col("dir") < 2, F.flatten(F.array_repeat(head, n))).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, head).when(i % 2 == 0, tail).otherwise(F.when(F.col("dir") % 2 == 0, inner(there)).otherwise(inner(back))))))
    return tags.select("sprite_id", "tag_id", F.posexplode(once).alias("step", "frame"))


def sort_palette(palette: DataFrame, by: str = "luma", descending: bool = False, keys: list[str] = ()) -> DataFrame:
    """Adds place: transparent entries first, then by the value, entries of one value in their order."""
    from spritespark.functions.color import hsl_mid, hue_value_saturation, luma

    h, v, s = hue_value_saturation()
    value = {"red": F.col("r"), "green": F.col("g"), "blue": F.col("b"), "alpha": F.col("a"), "hue": h, "saturation": s, "value": v, "lightness": hsl_mid(), "luma": luma()}[by]
    w = Window.partitionBy(*keys, "__half").orderBy(F.col("__v").desc() if descending else F.col("__v").asc(), "idx") if keys else Window.partitionBy("__half").orderBy(F.col("__v").desc() if descending else F.col("__v").asc(), "idx")
    rows = palette.withColumns({"__v": value, "__half": F.col("a") > 0})
    clear = palette.filter("a = 0").groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = rows.withColumn("__p", F.row_number().over(w) - 1)
    rows = rows.join(clear, list(keys), "left") if keys else rows.join(F.broadcast(clear), how="cross")  # one number
    return rows.withColumn("place", F.col("__p") + F.when(F.col("__half"), F.coalesce("__n", F.lit(0))).otherwise(0)).drop("__v", "__half", "__n", "__p")


def render_order(cels: DataFrame, keys: list[str], hidden: str | None = None) -> DataFrame:
    """Adds place, back to front: layer + z, ties by z, then layer; hidden layers keep their slot and are removed after."""
    w = Window.partitionBy(*keys).orderBy(F.col("layer") + F.col("z"), "z", "layer")
    out = cels.withColumn("place", F.row_number().over(w) - 1)
    return out.filter(~F.col(hidden)) if hidden else out


def mask_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def mask_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def mask_invert(mask: DataFrame, keys: tuple = ("image_id",)) -> DataFrame:
    """What the mask's own bounds hold besides it."""
    box = mask.groupBy(*keys).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    grid = box.select(*keys, F.explode(F.expr("sequence(x1, x2)")).alias("x"), "y1", "y2").select(*keys, "x", F.explode(F.expr("sequence(y1, y2)")).alias("y"))
    return grid.join(mask, [*keys, "x", "y"], "left_anti")


# tiles


def cut_tiles(pixels: DataFrame, tw: int, th: int, keys: tuple = ("image_id",), value: str = "v") -> DataFrame:
    """(keys, u, v_, tile): each grid cell's content as its values in reading order; absent or transparent pixels are 0."""
    at = (F.col("y") % th) * tw + F.col("x") % tw
    cells = pixels.groupBy(*keys, F.floor(F.col("x") / tw).cast("int").alias("u"), F.floor(F.col("y") / th).cast("int").alias("w")).agg(F.sort_array(F.collect_list(F.struct(at.alias("p"), F.col(value).alias("c")))).alias("__l"))
    return cells.withColumn("tile", F.expr(f"array_join(transform(sequence(0, {tw * th - 1}), i -> coalesce(element_at(map_from_entries(__l), i), 0)), ',')")).drop("__l")


def number_tiles(cells: DataFrame, set_key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(tileset, tilemap): distinct tiles of a set numbered from 1 as first seen, by rows; the empty tile is 0."""
    empty = F.col("tile").rlike("^0(,0)*$")
    first = cells.filter(~empty).groupBy(set_key, "tile").agg(F.min(F.struct("w", "u")).alias("at"))
    tileset = first.select(set_key, "tile", F.row_number().over(Window.partitionBy(set_key).orderBy("at")).alias("tile_index"))
    return tileset, cells.join(tileset, [set_key, "tile"], "left").select(set_key, "u", "w", F.coalesce("tile_index", F.lit(0)).alias("tile_index"))


#: Flips in the order in which they are tried.
FLIPS = ("", "x", "y", "xy", "d", "xd", "xyd", "yd")


def flipped(side: int, how: str) -> list[int]:
    """The places of a square tile that its flipped form has, in reading order; a diagonal flip comes last."""

    def source(y: int, x: int) -> int:
        y, x = (x, y) if "d" in how else (y, x)
        return (side - 1 - y if "y" in how else y) * side + (side - 1 - x if "x" in how else x)

    return [source(y, x) for y in range(side) for x in range(side)]


def match_tiles(cells: DataFrame, side: int, allowed: str = "xyd", set_key: str = "image_id") -> DataFrame:
    """(set, u, w, tile_index, flip): cells by the first tile that they equal after a flip, the first flip in FLIPS that fits.

    cells: set, u, w, tile, as of ``cut_tiles``. allowed: none, x, y, xy, d or xyd, so that flips of flips are flips. The
    empty tile is 0. Tiles are grouped by the least of their forms, one aggregate instead of a search for each cell.
    """
    if allowed not in ("", "x", "y", "xy", "d", "xyd"):
        raise ValueError(f"no closed set of flips: {allowed}")
    names = [f for f in FLIPS if set(f) <= set(allowed)]
    t = F.split("tile", ",")
    forms = F.array(*(F.array_join(F.array(*(t[i] for i in flipped(side, f))), ",") for f in names))
    each = cells.select(set_key, "u", "w", "tile", forms.alias("forms")).withColumn("class", F.array_min("forms"))
    first = each.filter(~F.col("tile").rlike("^0(,0)*$")).groupBy(set_key, "class").agg(F.min(F.struct("w", "u", "tile")).alias("at"))
    tiles = first.select(set_key, "class", F.col("at.tile").alias("own"), F.row_number().over(Window.partitionBy(set_key).orderBy("at")).alias("tile_index"))
    flip = F.get(F.array(*map(F.lit, names)), F.array_position("forms", F.col("own")).cast("int") - 1)
    return each.join(tiles, [set_key, "class"], "left").select(set_key, "u", "w", F.coalesce("tile_index", F.lit(0)).alias("tile_index"), F.coalesce(flip, F.lit("")).alias("flip"))


def draw_tiles(tilemap: DataFrame, tiles: DataFrame, size: int, set_key: str = "image_id") -> DataFrame:
    """(set, x, y, v): square tiles drawn at their cells; the empty tile 0 draws nothing.

    tilemap: set, u, w, tile_index, flip_x, flip_y, flip_d; tiles: set, tile_index, x, y, v. A diagonal flip comes first.
    """
    px, py = F.when(F.col("flip_d"), F.col("y")).otherwise(F.col("x")), F.when(F.col("flip_d"), F.col("x")).otherwise(F.col("y"))
    turned = lambda flag, c: F.when(F.col(flag), size - 1 - c).otherwise(c)
    drawn = tilemap.filter("tile_index > 0").join(tiles, [set_key, "tile_index"])
    return drawn.select(set_key, (F.col("u") * size + turned("flip_x", px)).alias("x"), (F.col("w") * size + turned("flip_y", py)).alias("y"), "v")


def pack_tiles(tilemap: DataFrame, set_key: str = "image_id") -> DataFrame:
    """(set, tile_index, packed): tiles in use, numbered densely in their order."""
    used = tilemap.filter("tile_index > 0").select(set_key, "tile_index").distinct()
    return used.withColumn("packed", F.row_number().over(Window.partitionBy(set_key).orderBy("tile_index")))
