"""Palettes made of sprites, colour maps, carried errors and packed sheets."""

from pyspark.sql import functions as F

from spritespark.operators import palettes as P
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X

_ORDER = ("frame", "layer", "y", "x")


@query("palette_median_cut", "WITH c AS (SELECT sprite_id, r, g, b, a, min((frame*3+layer)*1000000+y*32+x) AS first FROM anim_rgba WHERE a>0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY sprite_id ORDER BY first)-1 AS k FROM c) SELECT sprite_id, CASE WHEN k>=2 THEN k+1 ELSE k END AS idx, r, g, b, a FROM n UNION ALL SELECT sprite_id, 2, 0, 0, 0, 0 FROM n GROUP BY sprite_id HAVING count(*)>=2")
def palette_median_cut(spark, d):
    """Of at most 256 colours with the mask in place 2: sprites with fewer colours have them all, in the order of their first pixels."""
    return P.optimized_palettes(X.anim_rgba(spark, d), 256, _ORDER, 2)


@query("palette_median_cut_16")
def palette_median_cut_16(spark, d):
    return P.optimized_palettes(X.anim_rgba(spark, d), 16, _ORDER)


_FIT = "q AS (SELECT idx*16 AS idx, (idx*16*37)%256 AS r, (idx*16*91)%256 AS g, (idx*16*151)%256 AS b, CASE WHEN idx=2 THEN 0 ELSE 255 END AS a FROM range(16) t(idx)), near AS (SELECT c.cell, c.a AS ca, q.idx, row_number() OVER (PARTITION BY c.cell ORDER BY ((c.r>>3)-(q.r>>3))*((c.r>>3)-(q.r>>3))*900+((c.g>>3)-(q.g>>3))*((c.g>>3)-(q.g>>3))*3481+((c.b>>3)-(q.b>>3))*((c.b>>3)-(q.b>>3))*121+((c.a>>3)-(q.a>>3))*((c.a>>3)-(q.a>>3))*64, q.idx) AS k FROM c JOIN q ON q.idx<>32)"


@query("rgb5a3_map", f"WITH p AS (SELECT *, ((r>>3)<<13)+((g>>3)<<8)+((b>>3)<<3)+(a>>5) AS cell FROM emb_rgba), c AS (SELECT cell, r, g, b, a FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY image_id, y, x) AS k FROM p) WHERE k=1), {_FIT} SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, CASE WHEN n.ca>>3=0 THEN 32 ELSE n.idx END AS idx FROM p JOIN near n ON n.cell=p.cell AND n.k=1")
def rgb5a3_map(spark, d):
    """Sixteen entries, 32 being the mask: a colour takes the entry of the first colour that its cell has in the corpus."""
    entries = X.pal256(spark).filter("idx % 16 = 0")
    return P.mapped_by_cells(X.emb_rgba(spark, d), entries, ("image_id", "y", "x"), 32)


_LEVELS = [(0, 0), (1, 70), (2, 150), (3, 250)]
_NEAREST = "list_sort([" + ", ".join(f"{{'d': abs((v>>3)-{p >> 3}), 'i': {i}, 'p': {p}}}" for i, p in _LEVELS) + "])[1]"
_STEP = """n AS (SELECT image_id, y*8+CASE WHEN y%2=0 THEN x ELSE 7-x END AS k, x, y, v FROM emb_gray),
run AS (
  SELECT image_id, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS x, CAST(-1 AS BIGINT) AS y, CAST(0 AS BIGINT) AS idx, [0::BIGINT,0,0,0,0,0,0,0,0,0] AS cur, [0::BIGINT,0,0,0,0,0,0,0,0,0] AS nxt FROM (SELECT DISTINCT image_id FROM n)
  UNION ALL
  SELECT image_id, k, x, y, m.i AS idx,
    list_transform(range(1, 11), lambda i: c[i] + CASE WHEN i=x+2+s THEN (q*7)//16 ELSE 0 END),
    list_transform(range(1, 11), lambda i: e[i] + CASE WHEN i=x+2-s THEN (q*3)//16 WHEN i=x+2 THEN (q*5)//16 WHEN i=x+2+s THEN q//16 ELSE 0 END)
  FROM (SELECT *, (v-m.p)*75//100 AS q FROM (SELECT *, {near} AS m FROM (
    SELECT image_id, k, x, y, c, e, s, greatest(0, least(255, src+c[x+2])) AS v FROM (
      SELECT r.image_id, n.k, n.x, n.y, n.v AS src, CASE WHEN n.y>r.y THEN r.nxt ELSE r.cur END AS c, CASE WHEN n.y>r.y THEN [0::BIGINT,0,0,0,0,0,0,0,0,0] ELSE r.nxt END AS e, CASE WHEN n.y%2=0 THEN 1 ELSE -1 END AS s
      FROM run r JOIN n ON n.image_id=r.image_id AND n.k=r.k+1)))))""".replace("{near}", _NEAREST)


@query("dither_error_diffusion", f"WITH RECURSIVE {_STEP} SELECT image_id, x, y, idx FROM run WHERE k>=0")
def dither_error_diffusion(spark, d):
    """Gray pictures to four uneven grays, three quarters of each rest being carried on."""
    p = X.emb_gray(spark, d)
    v = F.col("v")
    levels = spark.createDataFrame([(i, p, p, p, 255) for i, p in _LEVELS], "idx int, r int, g int, b int, a int")
    return P.diffused(p.select("image_id", "x", "y", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a")), levels, -1, 75)


def _lab(r, g, b):
    lin = lambda c: f"CASE WHEN {c}/255.0::DOUBLE<=0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055,2.4) END"
    return lin(r), lin(g), lin(b)


def _histogram(spark, d):
    return X.anim_rgba(spark, d).filter("a > 0").groupBy("sprite_id", "r", "g", "b").agg(F.count("*").alias("n"))


_SQUARE = "(h.c0-m.m0)*(h.c0-m.m0)+(h.c1-m.m1)*(h.c1-m.m1)+(h.c2-m.m2)*(h.c2-m.m2)"
_ROUNDS = ", ".join(f"a{t} AS (SELECT sprite_id, c0, c1, c2, n, idx FROM (SELECT h.*, m.idx, row_number() OVER (PARTITION BY h.sprite_id, h.r, h.g, h.b ORDER BY {_SQUARE}, m.idx) AS k FROM h JOIN m{t} m ON m.sprite_id=h.sprite_id) WHERE k=1), m{t + 1} AS (SELECT sprite_id, idx, sum(c0*n)/sum(n) AS m0, sum(c1*n)/sum(n) AS m1, sum(c2*n)/sum(n) AS m2 FROM a{t} GROUP BY sprite_id, idx)" for t in range(4))
_HISTOGRAM = "l AS (SELECT sprite_id, r, g, b, count(*) AS n, {} AS lr, {} AS lg, {} AS lb FROM anim_rgba WHERE a>0 GROUP BY sprite_id, r, g, b), k AS (SELECT *, cbrt(0.4122214708::DOUBLE*lr+0.5363325363::DOUBLE*lg+0.0514459929::DOUBLE*lb) AS x, cbrt(0.2119034982::DOUBLE*lr+0.6806995451::DOUBLE*lg+0.1073969566::DOUBLE*lb) AS y, cbrt(0.0883024619::DOUBLE*lr+0.2817188376::DOUBLE*lg+0.6299787005::DOUBLE*lb) AS z FROM l), h AS (SELECT sprite_id, r, g, b, n, 0.2104542553::DOUBLE*x+0.7936177850::DOUBLE*y-0.0040720468::DOUBLE*z AS c0, 1.9779984951::DOUBLE*x-2.4285922050::DOUBLE*y+0.4505937099::DOUBLE*z AS c1, 0.0259040371::DOUBLE*x+0.7827717662::DOUBLE*y-0.8086757660::DOUBLE*z AS c2 FROM k), m0 AS (SELECT sprite_id, row_number() OVER (PARTITION BY sprite_id ORDER BY n DESC, r, g, b)-1 AS idx, c0 AS m0, c1 AS m1, c2 AS m2 FROM h QUALIFY idx<4)".format(*_lab("r", "g", "b"))


@query("palette_kmeans_oklab", f"WITH {_HISTOGRAM}, {_ROUNDS} SELECT m.sprite_id, m.idx, round(m0, 5) AS l, round(m1, 5) AS ca, round(m2, 5) AS cb FROM m3 m")
def palette_kmeans_oklab(spark, d):
    """Four centres a sprite after three rounds from its most frequent colours."""
    centres, _ = P.kmeans_palettes(_histogram(spark, d), 4, 3, None)
    return centres.select("sprite_id", "idx", *(F.round(f"m{i}", 5).alias(n) for i, n in enumerate(("l", "ca", "cb"))))


@query("palette_kmeans_plus_plus", "SELECT sprite_id, least(6, count(DISTINCT idx)) AS entries, sum(1) AS pixels, true AS falling FROM anim_rgba WHERE a>0 GROUP BY sprite_id")
def palette_kmeans_plus_plus(spark, d):
    """Six drawn centres: as many as there can be, all pixels in one of them, and a cost that never rises."""
    from pyspark.sql import Window

    centres, costs = P.kmeans_palettes(_histogram(spark, d), 6, 4, 7)
    steps = costs.withColumn("before", F.lag("cost").over(Window.partitionBy("sprite_id").orderBy("round")))
    falling = steps.groupBy("sprite_id").agg(F.bool_and(F.coalesce(F.col("cost") <= F.col("before") + 1e-9, F.lit(True))).alias("falling"))
    return centres.groupBy("sprite_id").agg(F.count("*").alias("entries"), F.sum("n").alias("pixels")).join(falling, "sprite_id")


@query("sheet_layout_packed", "SELECT sheet, count(*) AS items, true AS inside, 0 AS overlaps, count(DISTINCT (w, h)) AS places, true AS dense FROM samples GROUP BY sheet")
def sheet_layout_packed(spark, d):
    """Every sample inside its sheet, none on another, those of equal size on one place, and the sheet no larger than a bound."""
    from spritespark.sources.files import stored

    s = X.samples(spark, d).withColumn("content", F.col("w") * 100 + F.col("h"))
    p = stored(P.packed_sheets(s, 1, 2, content="content"), "packed")
    spots = p.select("sheet", "x", "y", "w", "h").distinct()
    other = spots.select("sheet", *(F.col(c).alias(f"o{c}") for c in "xywh"))
    apart = "x + w <= ox OR ox + ow <= x OR y + h <= oy OR oy + oh <= y"
    meet = spots.join(other, "sheet").filter(f"(x <> ox OR y <> oy) AND NOT ({apart})").groupBy("sheet").agg(F.count("*").alias("overlaps"))
    area = spots.groupBy("sheet").agg(F.count("*").alias("places"), F.sum((F.col("w") + 1) * (F.col("h") + 1)).alias("area"))
    out = p.groupBy("sheet").agg(F.count("*").alias("items"), F.bool_and(F.expr("x >= 2 AND y >= 2 AND x + w <= width - 2 AND y + h <= height - 2")).alias("inside"), F.max((F.col("width") - 3) * (F.col("height") - 3)).alias("sheet_area"))
    return out.join(area, "sheet").join(meet, "sheet", "left").select("sheet", "items", "inside", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), "places", (F.col("sheet_area") <= 3 * F.col("area")).alias("dense"))
