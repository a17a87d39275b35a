"""Sprite sheets: samples, duplicates, layouts and metadata; every window is within one sheet or sprite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_sums() -> Column:
    """An image's content as text, an aggregate over its pixels: transparent ones are equal whatever their colour.

    Sums of position-dependent hashes, which combine before the shuffle.
    """
    from spritespark.functions.color import pack_rgba

    visible = F.when(F.col("a") > 0, pack_rgba()).otherwise(F.lit(0).cast("long"))
    one, two = F.xxhash64("x", "y", visible), F.hash("y", visible, "x").cast("long")
    return F.concat_ws(":", F.sum(F.shiftrightunsigned(one, 24)).cast("string"), F.sum(two).cast("string"), F.max("x"), F.max("y"), F.count("*"))


def image_hashes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash): positions count from the origin."""
    return pixels.groupBy(*keys).agg(content_sums().alias("hash"))


def merge_duplicates(hashes: DataFrame, order: str, within: tuple = ()) -> DataFrame:
    """Adds original: the first item of the same content. An aggregate and a join, so a blank image is no hot window."""
    first = hashes.groupBy(*within, "hash").agg(F.min(order).alias("original"))
    return hashes.join(first, [*within, "hash"])


def number_samples(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return samples.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def layout_line(samples: DataFrame, vertical: bool = False, border: int = 0, padding: int = 0, inner: int = 0, extrude: int = 0, sheet: str = "sheet", order: str = "item") -> DataFrame:
    """One row or column: each sample lies after the sizes of those before it."""
    grow = 2 * (inner + extrude)
    size = F.col("h" if vertical else "w") + grow + padding
    w = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = border + F.coalesce(F.sum(size).over(w), F.lit(0))
    return samples.withColumns({"x": F.lit(border) if vertical else at, "y": at if vertical else F.lit(border), "sw": F.col("w") + grow, "sh": F.col("h") + grow})


def layout_rows(samples: DataFrame, per_row: int | None, border: int = 0, padding: int = 0, columns: bool = False, sheet: str = "sheet", order: str = "item", by: str | None = None) -> DataFrame:
    """Bands of per_row samples, or of neighbours with the same ``by`` (a layer, tag or sprite); a band starts after the largest of each before it."""
    along, across = ("h", "w") if columns else ("w", "h")
    w = Window.partitionBy(sheet).orderBy(order)
    if by:
        new = F.when(F.col(by).eqNullSafe(F.lag(by).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        rows = samples.withColumn("__new", new).withColumn("band", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")
    else:
        rows = samples.withColumn("band", F.floor((F.row_number().over(w) - 1) / per_row))
    bands = rows.groupBy(sheet, "band").agg(F.max(across).alias("__most"))
    before = lambda keys, o: Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(sheet, "band", (border + F.coalesce(F.sum(F.col("__most") + padding).over(before([sheet], "band")), F.lit(0))).alias("__across"))
    at = border + F.coalesce(F.sum(F.col(along) + padding).over(before([sheet, "band"], order)), F.lit(0))
    out = rows.withColumn("__along", at).join(bands, [sheet, "band"])
    return out.withColumns({"x": F.col("__across" if columns else "__along"), "y": F.col("__along" if columns else "__across")}).drop("__along", "__across")


def sheet_size(slots: DataFrame, border: int = 0, power_of_two: bool = False, sheet: str = "sheet") -> DataFrame:
    out = slots.groupBy(sheet).agg((F.max(F.col("x") + F.col("w")) + border).alias("width"), (F.max(F.col("y") + F.col("h")) + border).alias("height"))
    if power_of_two:
        up = lambda c: F.array_min(F.filter(F.array(*(F.lit(1 << i) for i in range(31))), lambda p: p >= F.col(c)))
        out = out.withColumns({"width": up("width"), "height": up("height")})
    return out


def sheet_cells(width: int, height: int, w: int, h: int, x: int = 0, y: int = 0, pad: int = 0) -> str:
    """SQL of the frame that a pixel (x, y) of a sheet belongs to, by rows; null in padding."""
    columns = max(1, (width - x + pad) // (w + pad))
    return f"CASE WHEN x >= {x} AND y >= {y} AND (x - {x}) % {w + pad} < {w} AND (y - {y}) % {h + pad} < {h} AND (x - {x}) DIV {w + pad} < {columns} THEN ((y - {y}) DIV {h + pad}) * {columns} + (x - {x}) DIV {w + pad} END"


def import_sheet(pixels: DataFrame, width: int, height: int, w: int, h: int, x: int = 0, y: int = 0, pad: int = 0) -> DataFrame:
    """A sheet's pixels as frames of w by h."""
    out = pixels.withColumn("frame", F.expr(sheet_cells(width, height, w, h, x, y, pad))).filter("frame IS NOT NULL")
    return out.withColumns({"x": (F.col("x") - x) % (w + pad), "y": (F.col("y") - y) % (h + pad)})


def frame_json(frames: DataFrame) -> DataFrame:
    """frames: name, x, y, w, h, duration_ms. (name, json) in the array form of sheet metadata."""
    rect = lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.col("w"), F.col("h"))
    body = F.struct(F.col("name").alias("filename"), rect(F.col("x"), F.col("y")).alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"), rect(F.lit(0), F.lit(0)).alias("spriteSourceSize"), F.struct("w", "h").alias("sourceSize"), F.col("duration_ms").alias("duration"))
    return frames.select("name", F.to_json(body).alias("json"))


def sheet_json(frames: DataFrame, tags: DataFrame | None = None, key: str = "sprite_id") -> DataFrame:
    """(key, json): a sheet's metadata as one document, frames by name, with its size and its tags.

    frames: key, frame, name, x, y, w, h, duration_ms; tags: key, tag_id, name, from_frame, to_frame, dir.
    """
    body = F.struct(F.struct("x", "y", "w", "h").alias("frame"), F.lit(False).alias("rotated"), F.lit(False).alias("trimmed"), F.col("duration_ms").alias("duration"))
    ordered = F.sort_array(F.collect_list(F.struct("frame", F.struct("name", body.alias("body")).alias("e"))))
    out = frames.groupBy(key).agg(ordered.alias("l"), F.struct(F.max(F.col("x") + F.col("w")).alias("w"), F.max(F.col("y") + F.col("h")).alias("h")).alias("size"))
    meta = [F.col("size")]
    if tags is not None:
        way = F.element_at(F.array(*map(F.lit, ("forward", "reverse", "pingpong", "pingpong_reverse"))), F.col("dir") + 1)
        tag = F.struct("name", F.col("from_frame").alias("from"), F.col("to_frame").alias("to"), way.alias("direction"))
        listed = tags.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("tag_id", tag.alias("t")))), lambda e: e["t"]).alias("frameTags"))
        out, meta = out.join(listed, key, "left"), [F.col("size"), F.col("frameTags")]
    return out.select(key, F.to_json(F.struct(F.map_from_entries(F.transform("l", lambda e: e["e"])).alias("frames"), F.struct(*meta).alias("meta"))).alias("json"))


def read_sheet_json(documents: DataFrame, key: str = "sprite_id") -> DataFrame:
    """(key, name, x, y, w, h, duration_ms) of documents whose frames are listed by name."""
    got = F.from_json("json", "frames map<string, struct<frame:struct<x:int,y:int,w:int,h:int>, duration:int>>")
    return documents.select(key, F.explode(got["frames"]).alias("name", "f")).select(key, "name", "f.frame.*", F.col("f.duration").alias("duration_ms"))


def read_frame_json(lines: DataFrame) -> DataFrame:
    """The other way: json -> name, x, y, w, h, duration_ms."""
    got = F.from_json("json", "filename string, frame struct<x:int,y:int,w:int,h:int>, duration int")
    return lines.select(got.alias("f")).select(F.col("f.filename").alias("name"), "f.frame.x", "f.frame.y", "f.frame.w", "f.frame.h", F.col("f.duration").alias("duration_ms"))


def split_name(name: str = "name") -> list:
    """left, number, right and width of a numbered file name; number null where it has none, or one beyond 64 bits."""
    stem = F.regexp_extract(name, r"^(.*?)([0-9]*)(\.[^.]*)?$", 1)
    digits = F.regexp_extract(name, r"^(.*?)([0-9]*)(\.[^.]*)?$", 2)
    right = F.regexp_extract(name, r"^(.*?)([0-9]*)(\.[^.]*)?$", 3)
    return [stem.alias("left"), F.when(digits != "", digits.try_cast("bigint")).alias("number"), right.alias("right"), F.length(digits).alias("width")]


def format_name(template: str, fields: dict) -> Column:
    """A template such as {title}-{tag}-{frame001}: {frame000} gives digits and first number, other names their field."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{(\w+?)(\d*)\}", template):
        out.append(F.lit(template[at : m.start()]))
        name, digits = m[1], m[2]
        value = fields.get(name)
        if value is None:
            out.append(F.lit(m[0]))
        elif digits:
            out.append(F.lpad((value + int(digits)).cast("string"), len(digits), "0"))
        else:
            out.append(F.coalesce(value.cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
