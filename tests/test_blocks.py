"""Blocks with what surrounds them, against whole pictures."""

import numpy as np
import pytest

from spritespark.operators import blocks as B


def median(img, w, h):
    top, left = h // 2, w // 2
    p = np.pad(img, ((top, h - 1 - top), (left, w - 1 - left)), "edge")
    return np.sort(np.lib.stride_tricks.sliding_window_view(p, (h, w)).reshape(*img.shape, -1), 2)[..., w * h // 2]


@pytest.mark.parametrize("side, w, h", [(8, 3, 3), (8, 17, 17), (16, 5, 9), (5, 4, 2), (64, 17, 1)])
def test_medians_of_cut_pictures(spark, side, w, h):
    rng = np.random.default_rng(side)
    pictures = {i: rng.integers(0, 256, size) for i, size in enumerate([(1, 1), (23, 37), (8, 8), (40, 3)])}
    pixels = spark.createDataFrame([(i, x, y, int(img[y, x])) for i, img in pictures.items() for y in range(img.shape[0]) for x in range(img.shape[1])], "image_id long, x int, y int, v int")
    blocks = B.blocks_of(pixels, side)
    assert {(r.image_id, r.x, r.y): r.v for r in B.pixels_of(blocks, side).collect()} == {(r.image_id, r.x, r.y): r.v for r in pixels.collect()}
    got = {(r.image_id, r.x, r.y): r.v for r in B.pixels_of(B.median_blocks(blocks, w, h, side), side).collect()}
    want = {i: median(img, w, h) for i, img in pictures.items()}
    assert got == {(i, x, y): int(m[y, x]) for i, m in want.items() for y in range(m.shape[0]) for x in range(m.shape[1])}
