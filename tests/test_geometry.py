"""Layouts, reference colours and palette files in small cases."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spritespark.operators import grouped as G
from spritespark.operators import points as P
from spritespark.operators.palettes import packed_sheets
from spritespark.sources import files


def test_packed_samples_lie_inside_and_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, int(rng.integers(1, 30)), int(rng.integers(1, 20))) for s in range(3) for i in range(25)] + [(9, 0, 90, 3), (9, 1, 4, 4)]
    samples = spark.createDataFrame(rows, "sheet long, item int, w int, h int")
    for layout in (packed_sheets(samples), G.wrapped_layout(samples, 64)):
        got = layout.collect()
        assert sorted((r.sheet, r.item, r.w, r.h) for r in got) == sorted(rows)
        for sheet in (0, 1, 2, 9):
            own = [r for r in got if r.sheet == sheet]
            assert all(r.x >= 0 and r.y >= 0 and r.x + r.w <= (r.width if "width" in r else max(64, *(o.w for o in own))) for r in own)
            assert all(a.x + a.w <= b.x or b.x + b.w <= a.x or a.y + a.h <= b.y or b.y + b.h <= a.y for a, b in combinations(own, 2))


def test_trim_color(spark):
    images = {"one colour": "aaa/aba/aaa", "clear corner": ".aa/aba/aaa", "clear in the top row": "a.a/aba/aaa", "clear at the left": "aaa/.ba/aaa", "two sides": "aaa/aba/bbb", "left and right": "aab/aab/acb", "only the bottom": "abc/aba/ccc", "none solid": "abc/bbb/cab"}
    of = {".": 0, "a": 1, "b": 2, "c": 3}
    rows = [(k, x, y, of[c], 0, 0, 255 if of[c] else 0) for k, t in images.items() for y, line in enumerate(t.split("/")) for x, c in enumerate(line)]
    got = P.trim_color(spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, a int"), 3, 3).collect()
    name = {None: None, 0: "."} | {of[c] + (255 << 24): c for c in "abc"}
    assert {r.image_id: name[r.color] for r in got} == {"one colour": "a", "clear corner": ".", "clear in the top row": ".", "clear at the left": ".", "two sides": None, "left and right": None, "only the bottom": "c", "none solid": "a"}


def test_palette_files(spark):
    texts = [("good", "JASC-PAL\n0100\n3\n1 2 3\n\n4 5 6 7\n"), ("other kind", "PAL\n0100\n1\n1 2 3\n"), ("other version", "JASC-PAL\n0200\n1\n1 2 3\n")]
    lines = spark.createDataFrame(texts, "file string, text string").select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    assert sorted(map(tuple, files.parse_pal(lines).collect())) == [("good", 0, 1, 2, 3, 255), ("good", 1, 4, 5, 6, 7)]
    colors = bytes(range(256)) * 3
    act = files.parse_act(spark.createDataFrame([("whole", colors), ("two", colors + b"\x00\x02"), ("most", colors + b"\x01\x80")], "file string, content binary"))
    assert {r.file: r.n for r in act.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"whole": 256, "two": 2, "most": 256}
    assert [tuple(r)[1:] for r in act.filter("file = 'two'").orderBy("idx").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5)]


def test_shared_folder_must_be_set_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        files.shared_folder(Session)


@pytest.mark.parametrize("colors", [1, 3, 12, 16, 40])
def test_octree_palette_keeps_all_pixels(spark, colors):
    rng = np.random.default_rng(5)
    rows = [(0, *map(int, c), 255) for c in rng.integers(0, 256, (300, 3))]
    p = spark.createDataFrame(rows, "sprite_id long, r int, g int, b int, a int")
    got = G.octree_palette(G.octree_sums(p), colors).collect()
    assert 1 <= len(got) <= colors and sum(r.n for r in got) == len(rows)
    mean = np.mean([r[1:4] for r in rows], axis=0)
    assert np.abs(np.sum([[r.r * r.n, r.g * r.n, r.b * r.n] for r in got], axis=0) / len(rows) - mean).max() <= 0.51
    exact = G.octree_palette(G.octree_sums(p), 400).collect()
    assert {(r.r >> 1, r.g >> 1, r.b >> 1) for r in exact} == {(r[1] >> 1, r[2] >> 1, r[3] >> 1) for r in rows}
