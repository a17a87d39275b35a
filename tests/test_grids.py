"""Grid detection and refinement on planted grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spritespark.operators import grids as G
from spritespark.operators import neighbors as N


def planted(pitch, phase, n, size, seed=0, missing=0.0, spurious=0, floor=0.0):
    rng = np.random.default_rng(seed)
    s = rng.random(size) * floor
    for k in range(n + 1):
        at = math.floor(phase + k * pitch + 0.5)
        if at < size and rng.random() >= missing:
            s[at] += 20 + 30 * rng.random()
    s[rng.integers(0, size, spurious)] += 25
    return s


def apart(a, b, p):
    return abs((a - b + p / 2) % p - p / 2)


@pytest.mark.parametrize("pitch, phase", [(9.4, 8.8), (5.5, 3.0), (3.25, 0.5), (17.3, 16.9), (31.7, 4.0), (8.0, 0.0)])
@pytest.mark.parametrize("trouble", [{}, {"missing": 0.35}, {"spurious": 5}, {"floor": 6.0}, {"missing": 0.2, "spurious": 4, "floor": 4.0}])
def test_pitch_and_phase_of_a_planted_comb(pitch, phase, trouble):
    n = 40
    fit, p, o = G.pitch_of(planted(pitch, phase, n, int(pitch * n + phase) + 20, 3, **trouble))
    assert fit >= 0.5 and abs(p - pitch) < 0.05 and apart(o, phase, pitch) < 0.5, (fit, p, o)


def test_no_grid_in_noise_or_silence():
    rng = np.random.default_rng(2)
    assert G.pitch_of(np.zeros(300))[:2] == (0.0, 1.0) and G.pitch_of(np.zeros(0))[:2] == (0.0, 1.0)
    assert G.pitch_of(np.r_[np.zeros(20), 30.0, np.zeros(20)])[:2] == (0.0, 1.0)
    assert G.pitch_of(10 + rng.random(200) * 0.1)[0] < 0.9


def sprite(seed, w=40, h=32, colors=6):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 256, (colors, 3))
    return palette[rng.integers(0, colors, (h, w))]


def rows_of(img, image_id):
    h, w, _ = img.shape
    return [(image_id, x, y, *map(int, img[y, x]), 255) for y in range(h) for x in range(w)]


def test_enlarged_frames_round_trip(spark):
    """The gate of the published round trip: blurred and noisy frames give their grid, and most cells their exact colour."""
    small = spark.createDataFrame([r for i in range(2) for r in rows_of(sprite(i), i)], "image_id long, x int, y int, r int, g int, b int, a int")
    big = G.enlarge(small, 9.4, 37, 53)
    kernel = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
    noisy = N.convolve(big, 37 + 376, 53 + 301, kernel).withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + (F.randn(5 + k) * 2).cast("int"))) for k, c in enumerate("rgb")}).cache()
    gray = noisy.withColumn("v", F.floor((F.col("r") + F.col("g") + F.col("b")) / 3).cast("int"))
    grid = G.native_grid(N.edge_signal(gray)).cache()
    for r in grid.collect():
        assert abs(r.pitch_x - 9.4) < 0.05 and abs(r.pitch_y - 9.4) < 0.05 and apart(r.phase_x, 37, 9.4) < 0.5 and apart(r.phase_y, 53, 9.4) < 0.5, r
    cells = G.native_cells(noisy, grid)
    lowest = cells.groupBy("image_id").agg(F.min("u").alias("u0"), F.min("w").alias("w0"))
    got = cells.join(lowest, "image_id").select("image_id", (F.col("u") - F.col("u0")).alias("x"), (F.col("w") - F.col("w0")).alias("y"), *(F.col(c).alias(f"n{c}") for c in "rgb"))
    near = F.greatest(*(F.abs(F.col(c) - F.col(f"n{c}")) for c in "rgb")) <= 8
    fidelity = small.join(got, ["image_id", "x", "y"], "left").select(F.avg(F.coalesce(near.cast("int"), F.lit(0)))).first()[0]
    assert fidelity >= 0.78


def test_a_native_picture_has_pitch_one(spark):
    small = spark.createDataFrame(rows_of(sprite(3), 0), "image_id long, x int, y int, r int, g int, b int, a int").withColumn("v", F.col("r"))
    r = G.native_grid(N.edge_signal(small)).first()
    assert (r.pitch_x, r.phase_x) == (1.0, 0.0) or r.fit >= 0.5


def test_refinement_comes_back_to_the_planted_grid(spark):
    small = spark.createDataFrame(rows_of(sprite(4, 12, 10), 0), "image_id long, x int, y int, r int, g int, b int, a int")
    big = G.enlarge(small, 7.5).cache()
    start = spark.createDataFrame([(0, 7.5, 7.5, 3.6, -3.6)], "image_id long, pitch_x double, pitch_y double, phase_x double, phase_y double")
    r = G.refined_grid(big, start, ((0.0, 1.5), (0.0, 1.5), (0.02, 0.5))).first()
    assert r.compactness <= 3.0 and apart(r.phase_x, 0, 7.5) < 3 and apart(r.phase_y, 0, 7.5) < 3
    assert G.compactness(big, start).first().compactness > 10
