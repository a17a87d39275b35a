"""Cuts, clusters, carried errors and packing against plain versions and their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spritespark.operators import palettes as P


def plain_cut(bins, counts, colors):
    """The same rules on a dense grid of counts."""
    grid = {}
    for b, n in zip(map(tuple, bins.tolist()), counts.tolist(), strict=True):
        grid[b] = grid.get(b, 0) + n
    boxes, done, made = [((0, 0, 0, 0), (31, 63, 31, 31), 0)], [], 1
    inside = lambda low, high: {b: n for b, n in grid.items() if all(x <= v <= y for x, v, y in zip(low, b, high, strict=True))}

    def mean(low, high):
        own = inside(low, high)
        n = sum(own.values())
        return tuple(255 * (sum(b[c] * k for b, k in own.items()) // n) // m for c, m in enumerate((31, 63, 31, 31)))

    while boxes and len(boxes) < colors:
        boxes.sort(key=lambda x: (-np.prod([b - a + 1 for a, b in zip(x[0], x[1], strict=True)]), x[2]))
        low, high, _ = boxes.pop(0)
        own = inside(low, high)
        low, high = (tuple(f(b[c] for b in own) for c in range(4)) for f in (min, max))
        side = max(range(4), key=lambda c: (high[c] - low[c], -c))
        total, seen, cut = sum(own.values()), 0, None
        for i in range(low[side], high[side] + 1):
            plane = sum(n for b, n in own.items() if b[side] == i)
            seen += plane
            if seen > total - seen:
                cut = i if total - seen > 0 else i - 1 if seen - plane > 0 else None
                break
        if cut is None:
            if len(done) < colors:
                done.append(mean(low, high))
            continue
        put = lambda t, v: tuple(v if c == side else x for c, x in enumerate(t))
        boxes += [(low, put(high, cut), made), (put(low, cut + 1), high, made + 1)]
        made += 2
    boxes.sort(key=lambda x: (-np.prod([b - a + 1 for a, b in zip(x[0], x[1], strict=True)]), x[2]))
    return done + [mean(low, high) for low, high, _ in boxes][: colors - len(done)]


@pytest.mark.parametrize("n, colors", [(1, 4), (2, 2), (40, 8), (300, 16), (300, 64), (12, 40)])
def test_cut_boxes(n, colors):
    rng = np.random.default_rng(n + colors)
    bins = np.unique(np.c_[rng.integers(0, 32, n), rng.integers(0, 64, n), rng.integers(0, 32, n), np.full(n, 31)], axis=0)
    counts = rng.integers(1, 50, len(bins))
    got = P.cut_boxes(bins, counts, colors)
    assert got == plain_cut(bins, counts, colors) and len(got) <= colors


def test_exact_palettes_and_the_mask(spark):
    rows = [(1, k, *c, 255) for k, c in enumerate([(9, 9, 9), (1, 2, 3), (9, 9, 9), (200, 0, 0)])] + [(1, 9, 7, 7, 7, 0)] + [(2, k, (37 * k) % 256, (11 * k) % 256, k % 256, 255) for k in range(100)]
    df = spark.createDataFrame(rows, "sprite_id long, at int, r int, g int, b int, a int")
    got = {}
    for r in P.optimized_palettes(df, 8, ("at",), 1).collect():
        got.setdefault(r.sprite_id, {})[r.idx] = (r.r, r.g, r.b, r.a)
    assert got[1] == {0: (9, 9, 9, 255), 1: (0, 0, 0, 0), 2: (1, 2, 3, 255), 3: (200, 0, 0, 255)}
    assert sorted(got[2]) == list(range(8)) and got[2][1] == (0, 0, 0, 0)


def test_empty_centres_move_to_the_farthest_colours(spark, monkeypatch):
    rows = [(1, 0, 0, 0, 50), (1, 1, 1, 1, 40), (1, 2, 2, 2, 30), (1, 255, 255, 255, 1), (1, 255, 0, 0, 1), (2, 5, 5, 5, 3)]
    df = spark.createDataFrame(rows, "sprite_id long, r int, g int, b int, n long")
    same = df.select("sprite_id").distinct().select("sprite_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("idx"), *(F.lit(0.0).alias(f"m{i}") for i in range(3)))
    monkeypatch.setattr(P, "first_centres", lambda *_: same)
    centres, costs = P.kmeans_palettes(df, 3, 6, None)
    got = centres.filter("sprite_id = 1").collect()
    assert sorted((r.colors, r.n) for r in got) == [(1, 1), (1, 1), (3, 120)]
    by = {}
    for r in costs.orderBy("round").collect():
        by.setdefault(r.sprite_id, []).append(r.cost)
    assert all(b <= a + 1e-12 for c in by.values() for a, b in zip(c, c[1:], strict=False)) and centres.filter("sprite_id = 2").count() == 1


def test_too_large_a_palette_is_refused(spark):
    df = spark.range(300).select(F.col("id").alias("idx"))
    with pytest.raises(ValueError):
        P.small_palette(df)


@pytest.mark.parametrize("seed", range(6))
def test_free_rectangles(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(((int(w), int(h)) for w, h in rng.integers(1, 30, (60, 2))), key=lambda s: (-s[1], -s[0]))
    places, bottom = P.free_rectangles(sizes, 100)
    grid = np.zeros((bottom, 100), int)
    for (x, y), (w, h) in zip(places, sizes, strict=True):
        assert x + w <= 100
        grid[y : y + h, x : x + w] += 1
    assert grid.max() == 1 and grid.mean() > 0.8
    assert P.free_rectangles(sizes, 100, bottom - 1) is None or seed < 0
    assert P.free_rectangles(sizes, 100, bottom) == (places, bottom)


def test_colours_carry_to_the_right_neighbours(spark):
    """Two by two: 100 becomes 0 and leaves 43 ahead, 18 below before, 31 below and 6 below ahead, by turns."""
    df = spark.createDataFrame([(0, x, y, v, v, v, 255) for (x, y), v in {(0, 0): 100, (1, 0): 100, (0, 1): 0, (1, 1): 200}.items()], "image_id long, x int, y int, r int, g int, b int, a int")
    pal = spark.createDataFrame([(0, 0, 0, 0, 255), (1, 255, 255, 255, 255)], "idx int, r int, g int, b int, a int")
    got = {(r.x, r.y): r.idx for r in P.diffused(df, pal, -1).collect()}
    # (1, 0): 143 -> 255, rest -112: -21 to (0, 1), -35 to (1, 1); (1, 1): 200 + 6 - 35 = 171 -> 255, rest -84: -36 to (0, 1)
    assert got == {(0, 0): 0, (1, 0): 1, (1, 1): 1, (0, 1): 0}
