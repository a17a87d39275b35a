"""Small literal cases."""

import pytest
from pyspark.sql import functions as F

from spritespark.functions.blend import HSL, SEPARABLE, blend_rgba
from spritespark.operators import neighbors as N
from spritespark.operators import points as P
from spritespark.operators import structure as S
from spritespark.operators.sheets import split_name


def pixels(spark, rows):
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")


def test_bayer_matrices():
    assert N.bayer(2) == [[0, 2], [3, 1]]
    assert N.bayer(4)[0] == [0, 8, 2, 10]
    assert sorted(v for row in N.bayer(8) for v in row) == list(range(64))


def test_blend_over_transparent_backdrop_is_the_source(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 10, 20, 30, 200)], "br int, bg int, bb int, ba int, sr int, sg int, sb int, sa int")
    for mode in ("normal", "multiply", "hue", "soft_light"):
        out = blend_rgba(mode, ["br", "bg", "bb", "ba"], ["sr", "sg", "sb", "sa"])
        assert tuple(df.select(*out).first()) == (10, 20, 30, 200)


def test_luminosity_of_gray_over_a_colour_keeps_its_hue(spark):
    df = spark.createDataFrame([(200, 0, 0, 255, 100, 100, 100, 255)], "br int, bg int, bb int, ba int, sr int, sg int, sb int, sa int")
    r, g, b, a = df.select(*blend_rgba("luminosity", ["br", "bg", "bb", "ba"], ["sr", "sg", "sb", "sa"])).first()
    assert r > g == b and a == 255 and abs(0.3 * r + 0.59 * g + 0.11 * b - 100) < 2


def test_flatten_blends_in_every_mode(spark):
    modes = [*SEPARABLE, *HSL]
    rows = [(m, f, k % 2, k // 2 % 3, 0, (k * 37 + f * 91) % 256, (k * 53 + f * 17) % 256, (k * 71 + f * 29) % 256, (255, 180, 90)[(k + f) % 3], (255, 200)[k % 2], "normal" if f == 0 else m) for m in modes for f in (0, 1) for k in range(6)]
    cels = spark.createDataFrame(rows, "sprite_id string, place int, frame int, x int, y int, r int, g int, b int, a int, opacity int, mode string")
    got = {(r.sprite_id, r.frame, r.x): (r.r, r.g, r.b, r.a) for r in N.flatten(cels).collect()}
    for m in modes:
        low, high = (cels.filter((cels.sprite_id == m) & (cels.place == k)).select("frame", "x", *(F.col(c).alias(f"{c}{k}") for c in (*"rgba", "opacity"))) for k in (0, 1))
        under = low.join(high, ["frame", "x"])
        first = blend_rgba("normal", [F.lit(0)] * 4, ["r0", "g0", "b0", "a0"], F.col("opacity0"))
        under = under.select("frame", "x", "r1", "g1", "b1", "a1", "opacity1", *(v.alias(f"{c}0") for c, v in zip("rgba", first, strict=True)))
        for r in under.select("frame", "x", *(v.alias(c) for c, v in zip("rgba", blend_rgba(m, ["r0", "g0", "b0", "a0"], ["r1", "g1", "b1", "a1"], F.col("opacity1")), strict=True))).collect():
            assert got[m, r.frame, r.x] == (r.r, r.g, r.b, r.a), (m, r)


def test_flatten_fails_on_an_unknown_mode(spark):
    cels = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, 9, 255, 255, "normal"), (1, 1, 0, 0, 0, 9, 9, 9, 255, 255, "mix")], "sprite_id int, place int, frame int, x int, y int, r int, g int, b int, a int, opacity int, mode string")
    with pytest.raises(Exception, match="no blend mode mix"):
        N.flatten(cels).collect()


def test_long_numbers_in_names(spark):
    df = spark.createDataFrame([("img20240101123456.png",), ("a7.png",), ("b" + "9" * 30 + ".png",)], "name string")
    assert [r.number for r in df.select(*split_name()).collect()] == [20240101123456, 7, None]


def test_empty_image_has_no_trim_bounds(spark):
    df = pixels(spark, [(1, 0, 0, 9, 9, 9, 0), (2, 3, 4, 1, 1, 1, 255)])
    assert [tuple(r) for r in P.trim_bounds(df).collect()] == [(2, 3, 4, 1, 1)]


def test_image_diff_of_other_sizes_is_minus_one(spark):
    one, two = pixels(spark, [(1, 0, 0, 1, 1, 1, 255)]), pixels(spark, [(1, 0, 0, 1, 1, 1, 255), (1, 1, 0, 1, 1, 1, 255)])
    assert P.image_diff_count(one, two).first().n == -1


def test_playback_directions(spark):
    tags = spark.createDataFrame([(1, k, 0, 2, k, 2) for k in range(4)], "sprite_id int, tag_id int, from_frame int, to_frame int, dir int, rep int")
    got = {t: [r.frame for r in sorted(rows, key=lambda r: r.step)] for t, rows in _by(S.play(tags).collect(), "tag_id").items()}
    assert got == {0: [0, 1, 2, 0, 1, 2], 1: [2, 1, 0, 2, 1, 0], 2: [0, 1, 2, 1, 0], 3: [2, 1, 0, 1, 2]}


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_hidden_layers_keep_their_slot(spark):
    cels = spark.createDataFrame([(1, 0, 0, False), (1, 1, 2, True), (1, 2, 0, False)], "s int, layer int, z int, hidden boolean")
    assert [(r.layer, r.place) for r in S.render_order(cels, ["s"], "hidden").orderBy("place").collect()] == [(0, 0), (2, 1)]


def test_flatten_opaque_top_wins(spark):
    rows = [(1, 0, p, 0, 0, 50 * p, 0, 0, 255, 255, "normal") for p in (1, 2, 3)]
    cels = spark.createDataFrame(rows, "sprite_id int, frame int, place int, x int, y int, r int, g int, b int, a int, opacity int, mode string")
    assert tuple(N.flatten(cels).first())[4:] == (150, 0, 0, 255)


def test_glob_layers(spark):
    paths = spark.createDataFrame([("a",), ("a/a",), ("a/b",), ("b/a",), ("b/b/c",)], "path string")
    pick = lambda g: sorted(r.path for r in paths.filter(S.matches_glob("path", g)).collect())
    assert pick("a/*") == ["a/a", "a/b"] and pick("*/a") == ["a/a", "b/a"] and pick("b/*") == ["b/a", "b/b/c"] and pick("a") == ["a"]


def test_paths_of_deep_layers(spark):
    layers = spark.createDataFrame([(i, i - 1 if i else None, i, f"l{i}", i != 15) for i in range(20)], "layer_id int, parent_id int, level int, name string, visible boolean")
    got = {r.layer_id: (r.path, r.shown) for r in S.layer_paths(layers).collect()}
    assert got == {i: ("/".join(f"l{k}" for k in range(i + 1)), i < 15) for i in range(20)}


def test_histogram_stream(spark, small, tmp_path):
    from spritespark.sources.fixtures import anim_rgba
    from spritespark.streaming.histograms import histogram_stream

    anim_rgba(spark, small).filter("frame < 2").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = histogram_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ("sprite_id",)).writeStream.format("memory").queryName("h").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = P.color_histogram(spark.read.parquet(str(tmp_path / "in")), ("sprite_id",))
    got = spark.table("h")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.agg(F.sum("n")).first()[0] > 0
