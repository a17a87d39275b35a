"""Pixels are shuffled once, before they are multiplied."""

from spritespark import catalog
from spritespark.operators import neighbors as N


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rotsprite_shuffles_the_small_pictures_only(spark, small):
    assert _exchanges(catalog.queries()["rotsprite_resize"](spark, small)) == 1


def test_scale2x_of_a_picture_with_holes(spark):
    """Beside a hole or the edge, a pixel is its own neighbour."""
    at = {(0, 0): 1, (1, 0): 1, (3, 0): 2, (0, 1): 1, (1, 1): 3, (2, 2): 1, (3, 1): 2, (1, 2): 1}
    p = spark.createDataFrame([(7, x, y, v) for (x, y), v in at.items()], "image_id int, x int, y int, v int")
    want = {}
    for (x, y), v in at.items():
        u, d, l, r = (at.get((x + i, y + j), v) for i, j in ((0, -1), (0, 1), (-1, 0), (1, 0)))
        for i, j, a, b, c, e in ((0, 0, l, u, d, r), (1, 0, u, r, l, d), (0, 1, d, l, r, u), (1, 1, r, d, u, l)):
            want[2 * x + i, 2 * y + j] = a if a == b and a != c and b != e else v
    assert {(q.x, q.y): q.v for q in N.scale2x(p).collect()} == want


def test_onion_skin_shuffles_pixels_before_they_are_multiplied(spark, small):
    """By point: the ghosts' aggregate needs no shuffle of its own."""
    for name in ("onion_skin", "onion_skin_tint"):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        top = plan.split("Exchange ")[0]
        assert "collect_list" in top and "Generate explode(__k" in top
