"""Windows of 17 by 17 on blocks of 16, against SQL that joins every tap."""

from pyspark.sql import functions as F

from spritespark.operators import blocks as B
from spritespark.queries.grids import tiled
from spritespark.queries.registry import query

_TAPS = "taps AS (SELECT p.image_id, p.x, p.y, q.v AS v, 9-greatest(abs(dx.i), abs(dy.i)) AS k FROM tiled p JOIN range(-8, 9) dx(i) ON true JOIN range(-8, 9) dy(i) ON true JOIN tiled q ON q.image_id=p.image_id AND q.x=greatest(0, least(39, p.x+dx.i)) AND q.y=greatest(0, least(31, p.y+dy.i)))"


@query("median_blur_17", f"WITH {_TAPS} SELECT image_id, x, y, list_sort(list(v))[145] AS v FROM taps GROUP BY image_id, x, y")
def median_blur_17(spark, d):
    return B.pixels_of(B.median_blocks(B.blocks_of(tiled(spark, d), 16), 17, 17, 16), 16)


_WEIGHTS = [[9 - max(abs(i), abs(j)) for j in range(-8, 9)] for i in range(-8, 9)]
_ALL = sum(map(sum, _WEIGHTS))


@query("convolve_17", f"WITH {_TAPS}, s AS (SELECT image_id, x, y, sum(CASE WHEN v%5=0 THEN 0 ELSE v*k END) AS r, sum(CASE WHEN v%5=0 THEN 0 ELSE (255-v)*k END) AS g, sum(CASE WHEN v%5=0 THEN 0 ELSE k END) AS n, sum(CASE WHEN v%5=0 THEN 0 ELSE 255*k END) AS a FROM taps GROUP BY image_id, x, y) SELECT image_id, x, y, CAST(CASE WHEN n=0 THEN 0 ELSE r//n END AS BIGINT) AS r, CAST(CASE WHEN n=0 THEN 0 ELSE g//n END AS BIGINT) AS g, 0 AS b, CAST(a//{_ALL} AS BIGINT) AS a FROM s")
def convolve_17(spark, d):
    p = tiled(spark, d).select("image_id", "x", "y", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.lit(0).alias("b"), F.when(F.col("v") % 5 == 0, 0).otherwise(255).alias("a"))
    return B.pixels_of(B.convolve_blocks(B.blocks_of(p, 16, tuple("rgba")), _WEIGHTS, 16), 16, tuple("rgba"))
