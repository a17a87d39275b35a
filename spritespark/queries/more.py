"""Further listings, conversions and round trips over the projections."""

import uuid

from pyspark.sql import functions as F

from spritespark.functions.color import cielab, oklab
from spritespark.operators import lookups as L
from spritespark.operators import neighbors as N
from spritespark.operators import points as P
from spritespark.operators import sheets as H
from spritespark.operators import structure as S
from spritespark.operators.ranges import long_line
from spritespark.queries.registry import query
from spritespark.queries.structure import _CELLS, _SET, _tiles
from spritespark.sources import files
from spritespark.sources import fixtures as X


@query("used_tiles", f"WITH {_CELLS}, {_SET} SELECT DISTINCT c.image_id, ts.tile_index FROM cells c JOIN ts ON ts.image_id=c.image_id AND ts.tile=c.tile WHERE c.u>0")
def used_tiles(spark, d):
    tileset, tilemap = _tiles(spark, d)
    return L.used_entries(tileset.select("image_id", "tile_index"), tilemap.filter("u > 0"), ["image_id", "tile_index"])


@query("export_tileset", f"WITH {_CELLS}, {_SET}, t AS (SELECT image_id, tile_index, string_split(tile, ',') AS v FROM ts) SELECT image_id, tile_index, i%2 AS x, i//2 AS y, CAST(v[i+1] AS BIGINT) AS v FROM t, range(4) r(i)")
def export_tileset(spark, d):
    tileset, _ = _tiles(spark, d)
    each = tileset.select("image_id", "tile_index", F.posexplode(F.split("tile", ",")).alias("p", "c"))
    return each.select("image_id", "tile_index", (F.col("p") % 2).alias("x"), F.floor(F.col("p") / 2).alias("y"), F.col("c").cast("int").alias("v"))


@query("list_layers", "SELECT sprite_id, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM (SELECT sprite_id, CAST(layer AS VARCHAR) AS layer FROM anim) GROUP BY sprite_id")
def list_layers(spark, d):
    return X.anim(spark, d).groupBy("sprite_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("layer").cast("string"))), ",").alias("layers"))


@query("list_slices", "SELECT sprite_id, count(*) AS keys, min(frame_from) AS first, max(w*h) AS largest FROM slice_keys GROUP BY sprite_id")
def list_slices(spark, d):
    return X.slice_keys(spark, d).groupBy("sprite_id").agg(F.count("*").alias("keys"), F.min("frame_from").alias("first"), F.max(F.col("w") * F.col("h")).alias("largest"))


@query("canvas_resize", "WITH i AS (SELECT DISTINCT image_id FROM emb_gray), g AS (SELECT image_id, x.x, y.y FROM i, range(12) x(x), range(10) y(y)) SELECT g.image_id, g.x, g.y, coalesce(p.v, 7) AS v FROM g LEFT JOIN emb_gray p ON p.image_id=g.image_id AND p.x=g.x-2 AND p.y=g.y-1")
def canvas_resize(spark, d):
    """Two columns and a row more on each side, filled with the background."""
    p = X.emb_gray(spark, d)
    grid = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"))
    moved = N.crop(p, -2, -1, 12, 10).select("image_id", "x", "y", "v")
    return grid.join(moved, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("v", F.lit(7)).alias("v"))


@query("sheet_verify", "SELECT image_id, count(*) FILTER (WHERE (image_id*13+x*5+y)%97=0) AS n FROM emb_gray GROUP BY image_id")
def sheet_verify(spark, d):
    """Frames cut from a rendered sheet, of which some pixels were changed, against those that were placed: as many pixels differ."""
    p = X.emb_gray(spark, d)
    items = X.table(spark, d, "embeddings").select(F.col("label").alias("sheet"), F.col("vec_id").alias("item"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    slots = long_line(items, padding=1).select(F.col("item").alias("image_id"), "sheet", F.col("x").alias("sx"))
    changed = F.when((F.col("image_id") * 13 + F.col("x") * 5 + F.col("y")) % 97 == 0, 255 - F.col("v") + F.when(F.col("v") == 255 - F.col("v"), 1).otherwise(0)).otherwise(F.col("v"))
    texture = p.withColumn("v", changed).join(slots, "image_id").select("sheet", (F.col("x") + F.col("sx")).alias("x"), "y", "v")
    cells = texture.withColumn("sx", F.floor(F.col("x") / 9) * 9).join(slots, ["sheet", "sx"]).select("image_id", (F.col("x") - F.col("sx")).alias("x"), "y", "v")
    return P.image_diff_count(p, cells, channels=("v",))


_KERNEL = "k AS (SELECT * FROM (VALUES (0,-1,1),(-1,0,2),(0,0,4),(1,0,1)) t(dx,dy,wt)), t AS (SELECT p.image_id, p.x AS tx, p.y AS ty, k.wt, q.r, q.g, q.b, q.a FROM emb_rgba p, k JOIN emb_rgba q ON true WHERE q.image_id=p.image_id AND q.x=greatest(0,least(7,p.x+k.dx)) AND q.y=greatest(0,least(7,p.y+k.dy)))"
_WEIGHED = ", ".join(f"CAST(coalesce(sum(CASE WHEN a>0 THEN {c}*wt ELSE 0 END)//nullif(8-sum(CASE WHEN a>0 THEN 0 ELSE wt END),0),0) AS BIGINT) AS {c}" for c in "rgb")


@query("udf_kernel", f"WITH {_KERNEL} SELECT image_id, tx AS x, ty AS y, {_WEIGHED}, CAST(sum(a*wt)//8 AS BIGINT) AS a FROM t GROUP BY image_id, tx, ty")
def udf_kernel(spark, d):
    """A user's kernel from a text of named matrices."""
    text = "# kernels\nplain 1 1 0 0 { 1 } 1 0 rgba\nleaning 3 3 1 1\n  { 0 1 0  # above\n    2 4 1\n    0 0 0 } auto auto rgba\n"
    k = files.parse_kernels(spark.createDataFrame([("own", text)], "file string, text string")).filter("name = 'leaning'").first()
    return N.convolve(X.emb_rgba(spark, d), 8, 8, [k.weights[i * k.w : (i + 1) * k.w] for i in range(k.h)], k.div, k.bias)


@query("udf_dither_matrix", "SELECT image_id, x, y, v*3//255 + CASE WHEN (v*3-(v*3//255)*255)*3 > [0,1,2][1+x%3]*255+127 THEN 1 ELSE 0 END AS level FROM emb_gray")
def udf_dither_matrix(spark, d):
    return N.dither_levels(X.emb_gray(spark, d), 4, [[0, 1, 2]]).select("image_id", "x", "y", "level")


@query("dither_bayer_oklab")
def dither_bayer_oklab(spark, d):
    """Nearest palette colour in OKLab after the matrix has moved the lightness; colours and phases are deduplicated first."""
    p = X.emb_rgba(spark, d).withColumn("phase", N.matrix_at(N.bayer(4)))
    palette = _entries(spark)
    (l, a, b), (pl, pa, pb) = oklab(), oklab("pr", "pg", "pb")
    shifted = l + (F.col("phase") / 16.0 - 0.5) * 0.08
    distance = F.round((shifted - pl) * (shifted - pl) + (a - pa) * (a - pa) + (b - pb) * (b - pb), 9)
    found = L.nearest_palette(p, palette, distance, ("r", "g", "b", "phase"))
    return p.join(found, ["r", "g", "b", "phase"]).select("image_id", "x", "y", "idx")


@query("resize_bilinear", "WITH t AS (SELECT x.x, y.y, greatest(0.0, least(7.0, (x.x+0.5)*0.5-0.5)) AS fx, greatest(0.0, least(7.0, (y.y+0.5)*0.5-0.5)) AS fy FROM range(16) x(x), range(16) y(y)), u AS (SELECT x, y, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0, fx-floor(fx) AS dx, fy-floor(fy) AS dy FROM t) SELECT a.image_id, u.x, u.y, CAST(floor(a.v*(1-dx)*(1-dy)+b.v*dx*(1-dy)+c.v*(1-dx)*dy+e.v*dx*dy+0.5) AS BIGINT) AS v FROM u JOIN emb_gray a ON a.x=x0 AND a.y=y0 JOIN emb_gray b ON b.image_id=a.image_id AND b.x=least(7,x0+1) AND b.y=y0 JOIN emb_gray c ON c.image_id=a.image_id AND c.x=x0 AND c.y=least(7,y0+1) JOIN emb_gray e ON e.image_id=a.image_id AND e.x=least(7,x0+1) AND e.y=least(7,y0+1)")
def resize_bilinear(spark, d):
    return N.resize_bilinear(X.emb_gray(spark, d), 8, 8, 16, 16)


@query("src_palette_pal_act", "SELECT sprite_id, idx, r, g, b FROM palettes_asof WHERE frame_from=3")
def src_palette_pal_act(spark, d):
    """Six-digit colours, one a line, written and parsed again."""
    p = X.palettes_asof(spark, d).filter("frame_from = 3")
    lines = p.select(F.col("sprite_id").alias("file"), F.col("idx").alias("line_no"), F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb")).alias("line"))
    return files.parse_hex(lines).select(F.col("file").alias("sprite_id"), "idx", "r", "g", "b")


@query("src_palette_pal", "SELECT sprite_id, frame_from, idx, r, g, b, a FROM palettes_asof")
def src_palette_pal(spark, d):
    """JASC texts of the palettes, with alpha, written and parsed again."""
    key = F.concat_ws("/", "sprite_id", "frame_from")
    entries = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat_ws(" ", *"rgba").alias("line")))), lambda e: e["line"]), "\r\n")
    texts = X.palettes_asof(spark, d).groupBy(key.alias("file")).agg(F.concat(F.lit("JASC-PAL\r\n0100\r\n256\r\n"), entries, F.lit("\r\n")).alias("text"))
    parsed = files.parse_pal(texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")))
    part = F.split("file", "/")
    return parsed.select(part[0].cast("long").alias("sprite_id"), part[1].cast("int").alias("frame_from"), "idx", *"rgba")


@query("src_palette_act", "SELECT sprite_id, idx, r, g, b FROM palettes_asof WHERE frame_from=3 AND idx < CASE WHEN sprite_id%2=0 THEN 256 ELSE 100+sprite_id%50 END")
def src_palette_act(spark, d):
    """Bytes of the palettes of frame 3, half of them with a count at the end, parsed again."""
    colors = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb")).alias("h")))), lambda e: e["h"]), "")
    count = F.when(F.col("sprite_id") % 2 == 0, "").otherwise(F.lpad(F.hex(100 + F.col("sprite_id") % 50), 4, "0"))
    texts = X.palettes_asof(spark, d).filter("frame_from = 3").groupBy("sprite_id").agg(colors.alias("h"))
    return files.parse_act(texts.select(F.col("sprite_id").alias("file"), F.unhex(F.concat("h", count)).alias("content"))).withColumnRenamed("file", "sprite_id")


@query("compose_groups", "SELECT sprite_id, frame, x, y, r, g, b, CASE WHEN layer=0 THEN 128 ELSE 200 END AS a FROM anim_rgba WHERE a>0")
def compose_groups(spark, d):
    """System layers in one group, the others in a second; each frame has one layer, which takes its group's opacity."""
    p = X.anim_rgba(spark, d).withColumns({"place": F.col("layer"), "opacity": F.lit(255), "mode": F.lit("normal"), "group_id": F.when(F.col("layer") == 0, 0).otherwise(1)})
    groups = spark.createDataFrame([(0, 0, 128, "normal"), (1, 1, 200, "normal")], "group_id int, place int, opacity int, mode string")
    return N.compose_groups(p.drop("idx", "layer"), groups)


@query("cell_purity", "WITH g AS (SELECT p.p, o.o FROM (SELECT unnest([2,4]) AS p) p, range(4) o(o) WHERE o.o < p.p), c AS (SELECT image_id, g.p, g.o, (x+g.o)//g.p AS cx, (y+g.o)//g.p AS cy, v//32 AS v, count(*) AS n FROM emb_gray, g GROUP BY ALL), m AS (SELECT image_id, p, o, cx, cy, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL) SELECT image_id, p AS pitch, o AS phase, round(sum(most)/sum(n), 6) AS purity FROM m GROUP BY image_id, p, o")
def cell_purity(spark, d):
    p = X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 32).alias("v"))
    return N.cell_purity(p, [2, 4]).withColumn("purity", F.round("purity", 6))


@query("mask_bounds", "SELECT image_id, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h FROM emb_gray WHERE v%3=0 GROUP BY image_id")
def mask_bounds(spark, d):
    return P.bounds(S.mask_add(X.emb_gray(spark, d).filter("v % 3 = 0").select("image_id", "x", "y"), X.emb_gray(spark, d).filter("v % 6 = 0").select("image_id", "x", "y")), ("image_id",))


def _entries(spark):
    return X.pal256(spark).select("idx", *(F.col(c).alias(f"p{c}") for c in "rgba"))


@query("cielab", "WITH n AS (SELECT DISTINCT r, g, b FROM emb_rgba), l AS (SELECT r, g, b, CASE WHEN r/255.0::DOUBLE<=0.04045 THEN r/255.0::DOUBLE/12.92 ELSE pow((r/255.0::DOUBLE+0.055)/1.055,2.4) END AS x1, CASE WHEN g/255.0::DOUBLE<=0.04045 THEN g/255.0::DOUBLE/12.92 ELSE pow((g/255.0::DOUBLE+0.055)/1.055,2.4) END AS x2, CASE WHEN b/255.0::DOUBLE<=0.04045 THEN b/255.0::DOUBLE/12.92 ELSE pow((b/255.0::DOUBLE+0.055)/1.055,2.4) END AS x3 FROM n), z AS (SELECT r, g, b, 100*(0.4124::DOUBLE*x1+0.3576::DOUBLE*x2+0.1805::DOUBLE*x3)/95.047::DOUBLE AS x, (0.2126::DOUBLE*x1+0.7152::DOUBLE*x2+0.0722::DOUBLE*x3) AS y, 100*(0.0193::DOUBLE*x1+0.1192::DOUBLE*x2+0.9505::DOUBLE*x3)/108.883::DOUBLE AS z FROM l), f AS (SELECT r, g, b, CASE WHEN x>0.008856 THEN cbrt(x) ELSE 7.787::DOUBLE*x+16/116.0::DOUBLE END AS x, CASE WHEN y>0.008856 THEN cbrt(y) ELSE 7.787::DOUBLE*y+16/116.0::DOUBLE END AS y, CASE WHEN z>0.008856 THEN cbrt(z) ELSE 7.787::DOUBLE*z+16/116.0::DOUBLE END AS z FROM z) SELECT r, g, b, CAST(round(100*(116*y-16)) AS BIGINT) AS cl, CAST(round(100*500*(x-y)) AS BIGINT) AS ca, CAST(round(100*200*(y-z)) AS BIGINT) AS cb FROM f")
def cielab_query(spark, d):
    return X.emb_rgba(spark, d).select("r", "g", "b").distinct().select("r", "g", "b", *(F.round(100 * c).cast("long").alias(n) for n, c in zip(("cl", "ca", "cb"), cielab(), strict=True)))


def _square(one, two):
    return "+".join(f"({a}-{b})*({a}-{b})" for a, b in zip(one, two, strict=True))


_OWN, _ENTRY, _FIRST, _MIRROR = ("c.r", "c.g", "c.b"), ("q.r", "q.g", "q.b"), ("m.r1", "m.g1", "m.b1"), ("m.mr", "m.mg", "m.mb")
_TWO = f"c AS (SELECT DISTINCT r, g, b FROM emb_rgba), n AS (SELECT c.r, c.g, c.b, q.idx AS i1, q.r AS r1, q.g AS g1, q.b AS b1, {_square(_OWN, _ENTRY)} AS d1, row_number() OVER (PARTITION BY c.r, c.g, c.b ORDER BY {_square(_OWN, _ENTRY)}, q.idx) AS k FROM c, pal256 q), m AS (SELECT r, g, b, i1, r1, g1, b1, d1, greatest(0,least(255,2*r-r1)) AS mr, greatest(0,least(255,2*g-g1)) AS mg, greatest(0,least(255,2*b-b1)) AS mb FROM n WHERE k=1), t AS (SELECT m.r, m.g, m.b, m.i1, m.d1, q.idx AS i2, {_square(_FIRST, _ENTRY)} AS apart, row_number() OVER (PARTITION BY m.r, m.g, m.b ORDER BY {_square(_MIRROR, _ENTRY)}, q.idx) AS k FROM m, pal256 q)"


@query("dither_ordered_old", f"WITH {_TWO} SELECT p.image_id, p.x, p.y, CASE WHEN ([0,2,3,1][1+(y%2)*2+x%2]*4 + [0,2,3,1][1+((y//2)%2)*2+(x//2)%2])*apart < d1*16 THEN i2 ELSE i1 END AS idx FROM emb_rgba p JOIN t ON t.r=p.r AND t.g=p.g AND t.b=p.b WHERE t.k=1")
def dither_ordered_old(spark, d):
    """Two nearest colours, the second for the mirrored error; the matrix chooses by their distances."""
    p = X.emb_rgba(spark, d)
    palette = _entries(spark)
    square = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0))
    entry = lambda k: palette.select(F.col("idx").alias(f"i{k}"), *(F.col(f"p{c}").alias(f"{c}{k}") for c in "rgb"))
    one = L.nearest_palette(p, palette, square, ("r", "g", "b")).select("r", "g", "b", F.col("idx").alias("i1"), F.col("distance").alias("d1")).join(F.broadcast(entry(1)), "i1")
    mirrored = one.select("*", *(F.greatest(F.lit(0), F.least(F.lit(255), 2 * F.col(c) - F.col(f"{c}1"))).alias(f"m{c}") for c in "rgb"))
    two = L.nearest_palette(mirrored.select(*(F.col(f"m{c}").alias(c) for c in "rgb")), palette, square, ("r", "g", "b")).select(*(F.col(c).alias(f"m{c}") for c in "rgb"), F.col("idx").alias("i2"))
    both = mirrored.join(two, ["mr", "mg", "mb"]).join(F.broadcast(entry(2)), "i2")
    apart = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "rgb"), F.lit(0))
    pick = F.when(N.matrix_at(N.bayer(4)) * apart < F.col("d1") * 16, F.col("i2")).otherwise(F.col("i1"))
    return p.join(both.withColumn("apart", apart), ["r", "g", "b"]).select("image_id", "x", "y", pick.alias("idx"))


@query("rotsprite_resize")
def rotsprite_resize(spark, d):
    """Doubled three times along edges, then sampled down to 12 by 12."""
    p = X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 64).alias("v")).repartition("image_id")
    for _ in range(3):
        p = N.scale2x(p)
    return N.resize_nearest(p, 64, 64, 12, 12)


@query("sink_tables", "SELECT sprite_id, layer, count(*) AS n FROM anim GROUP BY sprite_id, layer")
def sink_tables(spark, d):
    """Pixels written to the shared folder, partitioned by layer, and counted from there."""
    path = f"{files.shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    files.write_tables({"pixels": X.anim(spark, d)}, path, "layer")
    return spark.read.parquet(f"{path}/pixels").groupBy("sprite_id", "layer").agg(F.count("*").alias("n"))


_INDEXED = "c AS (SELECT DISTINCT r, g, b, a FROM emb_rgba WHERE a>0), q AS (SELECT * FROM pal256 WHERE idx<>32), n AS (SELECT c.*, q.idx, row_number() OVER (PARTITION BY c.r, c.g, c.b, c.a ORDER BY CASE WHEN c.r=q.r AND c.g=q.g AND c.b=q.b AND c.a=q.a THEN 0 ELSE 1 END, 900*((c.r>>3)-(q.r>>3))*((c.r>>3)-(q.r>>3))+3481*((c.g>>3)-(q.g>>3))*((c.g>>3)-(q.g>>3))+121*((c.b>>3)-(q.b>>3))*((c.b>>3)-(q.b>>3))+64*((c.a>>3)-(q.a>>3))*((c.a>>3)-(q.a>>3)), q.idx) AS k FROM c, q)"


@query("convert_mode_to_indexed", f"WITH {_INDEXED} SELECT p.image_id, p.x, p.y, coalesce(n.idx, 32) AS idx FROM emb_rgba p LEFT JOIN n ON n.k=1 AND n.r=p.r AND n.g=p.g AND n.b=p.b AND n.a=p.a")
def convert_mode_to_indexed(spark, d):
    return L.to_indexed(X.emb_rgba(spark, d), X.pal256(spark), 32)


@query("convert_mode_gray", "SELECT image_id, x, y, idx, CASE WHEN idx=32 THEN 0 ELSE idx END AS r, CASE WHEN idx=32 THEN 0 ELSE 255 END AS a FROM doc_pixels")
def convert_mode_gray(spark, d):
    """Gray values to RGB and back: three equal channels have themselves as their luma."""
    p = X.doc_pixels(spark, d).withColumn("a", F.when(F.col("idx") == 32, 0).otherwise(255))
    gray = F.when(F.col("a") == 0, 0).otherwise(F.col("idx"))
    back = P.to_gray(p.withColumns({c: gray for c in "rgb"}))
    return back.select("image_id", "x", "y", "idx", F.col("v").alias("r"), "a")
