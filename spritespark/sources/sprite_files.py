"""Layered sprite files to normalized tables: each file is parsed in the task that holds it, tables are projections.

A parsed chunk is one row (path, kind, data as JSON, image as bytes); ``sprite_tables`` turns the kinds into the columns
of the sprite tables. Fixed values: the numbers of the file format's chunks and fields.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_MAGIC, FRAME_MAGIC = 0xA5E0, 0xF1FA
LAYER, CEL, TAGS, PALETTE, USER_DATA, SLICE, TILESET = 0x2004, 0x2005, 0x2018, 0x2019, 0x2020, 0x2022, 0x2023
SCHEMAS = {
    "sprite": "width int, height int, depth int, n_frames int, mask_index int, grid struct<x:int,y:int,w:int,h:int>",
    "frame": "frame int, duration_ms int",
    "layer": "layer_index int, type int, level int, flags int, blend_mode int, opacity int, name string",
    "cel": "frame int, layer_index int, x int, y int, opacity int, type int, z_index int, width int, height int, link int",
    "tag": "tag_id int, name string, from_frame int, to_frame int, dir int, repeat int",
    "palette": "frame_from int, idx int, r int, g int, b int, a int, name string",
    "slice_key": "slice string, frame_from int, bounds array<int>, center array<int>, pivot array<int>",
    "tileset": "tileset_id int, flags int, n_tiles int, w int, h int, name string",
    "user_data": "of string, at int, text string, color array<int>",
}


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def text(self) -> str:
        (n,) = self.take("H")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")


def parse(data: bytes) -> Iterator[tuple[str, dict, bytes | None]]:
    """(kind, fields, image) of everything in one file; raises ValueError where it is no sprite file."""
    r = _Reader(data)
    _, magic, frames, width, height, depth, _, _, _, _, mask = r.take("IHHHHHIHIIB")
    if magic != FILE_MAGIC:
        raise ValueError("not a sprite file")
    r.at = 36
    gx, gy, gw, gh = r.take("hhHH")
    yield "sprite", {"width": width, "height": height, "depth": depth, "n_frames": frames, "mask_index": mask, "grid": {"x": gx, "y": gy, "w": gw, "h": gh}}, None
    r.at, layers, last = 128, 0, ("sprite", 0)
    tags_left = tag_count = 0
    for frame in range(frames):
        start = r.at
        size, magic, old, duration, _, new = r.take("IHHHHI")
        if magic != FRAME_MAGIC:
            raise ValueError("a frame is damaged")
        yield "frame", {"frame": frame, "duration_ms": duration}, None
        for _ in range(new or old):
            at = r.at
            length, kind = r.take("IH")
            c = _Reader(data[:at + length], r.at)
            if kind == LAYER:
                flags, type_, level, _, _, blend, opacity = c.take("HHHHHHB3x")
                yield "layer", {"layer_index": layers, "type": type_, "level": level, "flags": flags, "blend_mode": blend, "opacity": opacity, "name": c.text()}, None
                last, layers = ("layer", layers), layers + 1
            elif kind == CEL:
                layer, x, y, opacity, type_, z = c.take("HhhBHh5x")
                cel, image = {"frame": frame, "layer_index": layer, "x": x, "y": y, "opacity": opacity, "type": type_, "z_index": z}, None
                if type_ == 1:
                    (cel["link"],) = c.take("H")
                else:
                    cel["width"], cel["height"] = c.take("HH")
                    if type_ == 3:
                        c.take("HIIII10x")
                    image = c.data[c.at :] if type_ == 0 else zlib.decompress(c.data[c.at :])
                yield "cel", cel, image
                last = ("cel", layer)
            elif kind == TAGS:
                (n,) = c.take("H8x")
                for k in range(n):
                    first, to, way, times = c.take("HHBH6x3xx")
                    yield "tag", {"tag_id": k, "from_frame": first, "to_frame": to, "dir": way, "repeat": times, "name": c.text()}, None
                tags_left = tag_count = n
            elif kind == PALETTE:
                _, first, to = c.take("III8x")
                for idx in range(first, to + 1):
                    named, red, green, blue, alpha = c.take("HBBBB")
                    yield "palette", {"frame_from": frame, "idx": idx, "r": red, "g": green, "b": blue, "a": alpha, "name": c.text() if named & 1 else None}, None
            elif kind == SLICE:
                n, flags, _ = c.take("III")
                name = c.text()
                for _ in range(n):
                    since, *box = c.take("IiiII")
                    yield "slice_key", {"slice": name, "frame_from": since, "bounds": box, "center": list(c.take("iiII")) if flags & 1 else None, "pivot": list(c.take("ii")) if flags & 2 else None}, None
                last = ("slice", 0)
            elif kind == TILESET:
                which, flags, n, w, h, _ = c.take("IIIHHh14x")
                name, image = c.text(), None
                if flags & 1:
                    c.take("II")
                if flags & 2:
                    (packed,) = c.take("I")
                    image = zlib.decompress(c.data[c.at : c.at + packed])
                yield "tileset", {"tileset_id": which, "flags": flags, "n_tiles": n, "w": w, "h": h, "name": name}, image
                last = ("tileset", which)
            elif kind == USER_DATA:
                (flags,) = c.take("I")
                of, at_ = ("tag", tag_count - tags_left) if tags_left else last
                tags_left -= tags_left > 0
                yield "user_data", {"of": of, "at": at_, "text": c.text() if flags & 1 else None, "color": list(c.take("BBBB")) if flags & 2 else None}, None
            r.at = at + length
        r.at = start + size


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, data, image, error): a damaged file gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out = [(name, k, json.dumps(d), i, None) for k, d, i in parse(bytes(content))]
                except (ValueError, struct.error, zlib.error) as e:
                    out = [(name, "error", None, None, str(e))]
                yield pd.DataFrame(out, columns=["path", "kind", "data", "image", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, kind string, data string, image binary, error string")


def sprite_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per kind, each with its file's path; cels and tilesets keep their pixels as ``image``."""
    return {kind: chunks.filter(F.col("kind") == kind).select("path", F.from_json("data", schema).alias("d"), *(["image"] if kind in ("cel", "tileset") else [])).select("path", "d.*", *(["image"] if kind in ("cel", "tileset") else [])) for kind, schema in SCHEMAS.items()}
