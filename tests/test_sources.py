import struct
import zlib

from pyspark.sql import functions as F

from spritespark.sources import files
from spritespark.sources.sprite_files import read_chunks, sprite_tables


def text(s):
    return struct.pack("<H", len(s.encode())) + s.encode()


def chunk(kind, body):
    return struct.pack("<IH", len(body) + 6, kind) + body


def frame(duration, *chunks):
    body = b"".join(chunks)
    return struct.pack("<IHHHHI", len(body) + 16, 0xF1FA, len(chunks), duration, 0, len(chunks)) + body


def sprite():
    image = bytes(range(8))
    one = frame(
        120,
        chunk(0x2004, struct.pack("<HHHHHHB3x", 1, 0, 0, 0, 0, 2, 200) + text("lay é")),
        chunk(0x2020, struct.pack("<I", 3) + text("note") + bytes((1, 2, 3, 4))),
        chunk(0x2019, struct.pack("<III8x", 2, 0, 1) + struct.pack("<HBBBB", 0, 9, 8, 7, 255) + struct.pack("<HBBBB", 1, 1, 2, 3, 4) + text("sky")),
        chunk(0x2018, struct.pack("<H8x", 1) + struct.pack("<HHBH6x3xx", 0, 1, 2, 3) + text("walk")),
        chunk(0x2005, struct.pack("<HhhBHh5x", 0, -1, 2, 255, 2, 1) + struct.pack("<HH", 4, 2) + zlib.compress(image)),
        chunk(0x2022, struct.pack("<III", 1, 3, 0) + text("box") + struct.pack("<IiiII", 0, 1, 2, 3, 4) + struct.pack("<iiII", 1, 1, 1, 1) + struct.pack("<ii", 5, 6)),
    )
    two = frame(80, chunk(0x2005, struct.pack("<HhhBHh5x", 0, 0, 0, 255, 1, 0) + struct.pack("<H", 0)))
    head = struct.pack("<IHHHHHIHIIB", 128 + len(one) + len(two), 0xA5E0, 2, 4, 2, 8, 1, 100, 0, 0, 5).ljust(36, b"\0") + struct.pack("<hhHH", 0, 0, 16, 16)
    return head.ljust(128, b"\0") + one + two, image


def test_sprite_files(spark, tmp_path):
    data, image = sprite()
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"nothing of the kind" * 20)
    chunks = read_chunks(spark, str(tmp_path))
    assert chunks.filter("kind = 'error'").count() == 1
    t = {k: [r.asDict(True) for r in df.drop("path").collect()] for k, df in sprite_tables(chunks).items()}
    assert t["sprite"] == [{"width": 4, "height": 2, "depth": 8, "n_frames": 2, "mask_index": 5, "grid": {"x": 0, "y": 0, "w": 16, "h": 16}}]
    assert [f["duration_ms"] for f in t["frame"]] == [120, 80]
    assert t["layer"][0]["name"] == "lay é" and t["layer"][0]["blend_mode"] == 2
    assert [(c["type"], c["link"]) for c in t["cel"]] == [(2, None), (1, 0)] and bytes(t["cel"][0]["image"]) == image
    assert t["tag"] == [{"tag_id": 0, "name": "walk", "from_frame": 0, "to_frame": 1, "dir": 2, "repeat": 3}]
    assert [p["name"] for p in t["palette"]] == [None, "sky"]
    assert t["slice_key"][0]["center"] == [1, 1, 1, 1] and t["slice_key"][0]["pivot"] == [5, 6]
    assert t["user_data"] == [{"of": "layer", "at": 0, "text": "note", "color": [1, 2, 3, 4]}]


def test_palette_files(spark, tmp_path):
    (tmp_path / "p.gpl").write_text("GIMP Palette\nName: x\n#\n 12  3 255\tSky\n0 0 0\n")
    got = files.parse_gpl(files.read_lines(spark, str(tmp_path / "p.gpl"))).orderBy("idx").drop("file").collect()
    assert [tuple(r) for r in got] == [(0, 12, 3, 255, "Sky"), (1, 0, 0, 0, "")]
    (tmp_path / "p.act").write_bytes(bytes(i % 256 for i in range(768)) + b"\1\0\0\0")
    got = files.read_act(spark, str(tmp_path / "p.act")).filter("idx = 200").first()
    assert (got.r, got.g, got.b) == tuple((600 + i) % 256 for i in range(3))
    (tmp_path / "q.act").write_bytes(bytes(768) + b"\0\2\0\0")  # two entries count
    assert files.read_act(spark, str(tmp_path / "q.act")).count() == 2


def test_image_files(spark, tmp_path):
    raw = b"".join(b"\0" + bytes(v for x in range(3) for v in (10 * x, 20 * y, 7)) for y in range(2))
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in files.read_images(spark, str(tmp_path / "i.png")).collect()}
    assert got == {(x, y): (10 * x, 20 * y, 7, 255) for x in range(3) for y in range(2)}


def test_tables_round_trip(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("part"))
    files.write_tables({"pixels": df}, str(tmp_path / "out"), "part")
    assert spark.read.parquet(str(tmp_path / "out/pixels")).count() == 10
