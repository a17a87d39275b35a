"""Fractional grids: detection, cells, refinement and the report, on enlarged pictures made of the vectors."""

from pyspark.sql import functions as F

from spritespark.operators import grids as G
from spritespark.operators import neighbors as N
from spritespark.operators.joins import shuffled
from spritespark.plans import native_pixels
from spritespark.queries.registry import FIXTURES, query
from spritespark.sources import fixtures as X

FIXTURES["tiled"] = "SELECT image_id//20 AS image_id, x + 8*(image_id%5) AS x, y + 8*(image_id%20//5) AS y, v FROM emb_gray"


def tiled(spark, d):
    """Twenty vectors as one picture of 40 by 32 pixels."""
    i = F.col("image_id")
    return X.emb_gray(spark, d).select(F.floor(i / 20).alias("image_id"), (F.col("x") + 8 * (i % 5)).cast("int").alias("x"), (F.col("y") + 8 * F.floor(i % 20 / 5)).cast("int").alias("y"), "v")


def _pitch(key="image_id", two=(9.4, 5.5)):
    return F.when(F.col(key) % 2 == 0, two[0]).otherwise(two[1])


def _apart(found, planted, pitch):
    return F.abs(F.pmod(found - planted + pitch / 2, pitch) - pitch / 2)


@query("grid_pitch_detect", "SELECT DISTINCT image_id, CASE WHEN image_id%2=0 THEN 9.4::DOUBLE ELSE 5.5::DOUBLE END AS pitch_x, CASE WHEN image_id%2=0 THEN 9.4::DOUBLE ELSE 5.5::DOUBLE END AS pitch_y, true AS pitch_near, true AS phase_near FROM tiled")
def grid_pitch_detect(spark, d):
    """Pictures enlarged by 9.4 and 5.5 and moved by (37, 53): the pitch to one place, and whether both are as near as they must be."""
    p = _pitch()
    found = G.native_grid(N.edge_signal(G.enlarge(tiled(spark, d), p, 37, 53)))
    near = lambda a: F.abs(F.col(f"pitch_{a}") - p) < 0.05
    return found.select("image_id", F.round("pitch_x", 1).alias("pitch_x"), F.round("pitch_y", 1).alias("pitch_y"), (near("x") & near("y")).alias("pitch_near"), ((_apart(F.col("phase_x"), 37, p) < 0.5) & (_apart(F.col("phase_y"), 53, p) < 0.5)).alias("phase_near"))


@query("grid_cells_fractional", "SELECT image_id, x AS u, y AS w, v FROM tiled")
def grid_cells_fractional(spark, d):
    """The cells of the found grids are the pixels that were enlarged."""
    p = _pitch()
    big = G.enlarge(tiled(spark, d), p, 37, 53)
    found = G.native_grid(N.edge_signal(big))
    cells = G.native_cells(big, found, alpha=None, channels=("v",))
    # a grid's phase is less than a pitch: cells are counted from the first one that the picture has
    first = cells.groupBy("image_id").agg(F.min("u").alias("u0"), F.min("w").alias("w0"))
    return shuffled(cells).join(first, "image_id").select("image_id", (F.col("u") - F.col("u0")).alias("u"), (F.col("w") - F.col("w0")).alias("w"), "v")


_STEPS = ((-0.2, 0.0, 0.2), (0.0, 1.5))
_COMPACT = """
big AS (SELECT e.image_id, gx.i AS x, gy.i AS y, e.v FROM emb_gray e JOIN range(40) gx(i) ON gx.i>=floor(e.x*4.5+0.5) AND gx.i<floor((e.x+1)*4.5+0.5) JOIN range(40) gy(i) ON gy.i>=floor(e.y*4.5+0.5) AND gy.i<floor((e.y+1)*4.5+0.5)),
g AS (SELECT p::DOUBLE AS pitch_x, o::DOUBLE AS phase_x FROM (SELECT unnest([4.3, 4.5, 4.7]) AS p), (SELECT unnest([0.0, 1.5]) AS o)),
placed AS (SELECT image_id, v, pitch_x, phase_x, (x+0.5::DOUBLE-phase_x)/pitch_x AS fx, (y+0.5::DOUBLE-0.0)/4.5::DOUBLE AS fy FROM big, g),
cells AS (SELECT image_id, pitch_x, phase_x, floor(fx) AS u, floor(fy) AS w, CAST(floor(median(v)) AS BIGINT) AS v FROM placed WHERE fx-floor(fx) BETWEEN 0.22::DOUBLE AND 0.78::DOUBLE AND fy-floor(fy) BETWEEN 0.22::DOUBLE AND 0.78::DOUBLE GROUP BY ALL),
modes AS (SELECT image_id, pitch_x, phase_x, m FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pitch_x, phase_x ORDER BY n DESC, m) AS k FROM (SELECT image_id, pitch_x, phase_x, v//6*6+3 AS m, count(*) AS n FROM cells GROUP BY ALL)) WHERE k<=10),
near AS (SELECT c.image_id, c.pitch_x, c.phase_x, c.u, c.w, min(abs(c.v-m.m)) AS d FROM cells c JOIN modes m USING (image_id, pitch_x, phase_x) GROUP BY ALL),
scores AS (SELECT image_id, pitch_x, phase_x, round(avg(d), 6) AS compactness, count(*) AS cells FROM near GROUP BY ALL)
"""


def _scores(spark, d):
    big = G.enlarge(X.emb_gray(spark, d), 4.5)
    start = big.select("image_id").distinct().withColumns({"pitch_x": F.lit(4.5), "pitch_y": F.lit(4.5), "phase_x": F.lit(0.0), "phase_y": F.lit(0.0)})
    return G.compactness(big, G.grid_candidates(start, *map(list, _STEPS), "x"), alpha=None, channels=("v",))


@query("grid_compactness", f"WITH {_COMPACT} SELECT * FROM scores")
def grid_compactness(spark, d):
    return _scores(spark, d).drop("pitch_y", "phase_y")


@query("grid_most_compact", f"WITH {_COMPACT} SELECT image_id, pitch_x, phase_x, compactness, cells FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY compactness, pitch_x, phase_x) AS k FROM scores) WHERE k=1")
def grid_most_compact(spark, d):
    return G.most_compact(_scores(spark, d)).drop("pitch_y", "phase_y")


def _animations(spark, d):
    """Five pictures as the frames of an animation in three gray levels with a tint, enlarged on a green canvas."""
    p = _pitch("sprite_id", (4.7, 3.4))
    level = F.floor(F.col("v") / 4) % 3 * 60
    small = tiled(spark, d).select(F.floor(F.col("image_id") / 5).alias("sprite_id"), (F.col("image_id") % 5).cast("int").alias("frame"), "x", "y", level.cast("int").alias("r"), F.lit(30).alias("g"), (level + 40).cast("int").alias("b"), F.lit(255).alias("a"))
    big = G.enlarge(small, p, 12, 9).select("sprite_id", "frame", "x", "y", *"rgba")
    canvas = small.select("sprite_id", "frame").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(209))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(169))).alias("y"))
    green = canvas.join(shuffled(big), ["sprite_id", "frame", "x", "y"], "left").select("sprite_id", "frame", "x", "y", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in zip("rgba", (10, 226, 70, 255), strict=True)))
    return green


_NATIVE = "t AS (SELECT image_id//5 AS sprite_id, image_id%5 AS frame, x, y, v//4%3 AS k FROM tiled), h AS (SELECT sprite_id, frame, k, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT p.sprite_id, p.frame, sum(abs(p.n-coalesce(c.n,0)))/sum(p.n) AS d FROM h p JOIN (SELECT DISTINCT sprite_id, frame FROM h) e ON e.sprite_id=p.sprite_id AND e.frame=p.frame+1 LEFT JOIN h c ON c.sprite_id=p.sprite_id AND c.frame=p.frame+1 AND c.k=p.k GROUP BY p.sprite_id, p.frame)"


@query("native_pixel_report", f"WITH {_NATIVE} SELECT t.sprite_id, count(DISTINCT frame) AS frames, 40 AS width, 32 AS height, count(*) AS cells, count(DISTINCT k) AS colors, 0.0::DOUBLE AS delta, 0 AS orphans, count(DISTINCT k) AS palette, any_value(round(m.d, 6)) AS flicker, CASE WHEN t.sprite_id%2=0 THEN 4.7::DOUBLE ELSE 3.4::DOUBLE END AS pitch_x, CASE WHEN t.sprite_id%2=0 THEN 4.7::DOUBLE ELSE 3.4::DOUBLE END AS pitch_y FROM t LEFT JOIN (SELECT sprite_id, avg(d) AS d FROM f GROUP BY sprite_id) m ON m.sprite_id=t.sprite_id GROUP BY t.sprite_id")
def native_pixel_report(spark, d):
    """Keyed, cut into the cells of the found grid and snapped to a shared palette: what was enlarged comes back."""
    out = native_pixels.native_report(_animations(spark, d), passes=0)
    return out.drop("phase_x", "phase_y").withColumns({"pitch_x": F.round("pitch_x", 1), "pitch_y": F.round("pitch_y", 1)})
