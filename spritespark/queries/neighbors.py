"""Geometry, neighbourhoods, compositing, dithering and backgrounds over the projections."""

from pyspark.sql import functions as F

from spritespark.functions.blend import SEPARABLE
from spritespark.operators import neighbors as N
from spritespark.operators.joins import shuffled
from spritespark.plans.sheet_export import export_sheet
from spritespark.queries.points import _sql_modes
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X


def _simple(name, sql, f, source=X.emb_rgba):
    query(name, sql)(lambda spark, d: f(source(spark, d)))


_simple("flip", "SELECT image_id, 7-x AS x, y, r, g, b, a FROM emb_rgba", lambda p: N.flip(p, 8, 8))
_simple("rotate90", "SELECT image_id, 7-y AS x, x AS y, r, g, b, a FROM emb_rgba", lambda p: N.rotate(p, 8, 8, 90))
_simple("transpose", "SELECT image_id, y AS x, x AS y, r, g, b, a FROM emb_rgba", N.transpose)
_simple("shift_wrap", "SELECT image_id, (x+5)%8 AS x, (y+7)%8 AS y, r, g, b, a FROM emb_rgba", lambda p: N.shift_wrap(p, 8, 8, -3, -1))
_simple("resize_nearest", "SELECT p.image_id, t.x, t.y, r, g, b, a FROM emb_rgba p JOIN (SELECT x.x, y.y FROM range(12) x(x), range(5) y(y)) t ON p.x=t.x*8//12 AND p.y=t.y*8//5", lambda p: N.resize_nearest(p, 8, 8, 12, 5))
_simple("crop", "SELECT image_id, x-2 AS x, y-1 AS y, r, g, b, a FROM emb_rgba WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6", lambda p: N.crop(p, 2, 1, 4, 6))


@query("crop_to_slice", "SELECT p.sprite_id, p.frame, p.layer, p.x-k.x AS x, p.y-k.y AS y, p.idx FROM anim p JOIN slice_keys k ON k.sprite_id=p.sprite_id AND k.frame_from=CASE WHEN p.frame>=4 THEN 4 WHEN p.frame>=1 THEN 1 END WHERE p.x>=k.x AND p.x<k.x+k.w AND p.y>=k.y AND p.y<k.y+k.h")
def crop_to_slice(spark, d):
    from spritespark.operators.lookups import as_of

    p = X.anim(spark, d)
    key = as_of(p.select("sprite_id", "frame").distinct(), X.slice_keys(spark, d).withColumnsRenamed({"x": "sx", "y": "sy"}), ["sprite_id"], kind="inner")
    return N.crop(shuffled(p).join(key, ["sprite_id", "frame"]), F.col("sx"), F.col("sy"), F.col("w"), F.col("h")).select("sprite_id", "frame", "layer", "x", "y", "idx")


_simple("extrude", "SELECT p.image_id, t.x, t.y, v FROM emb_gray p JOIN (SELECT x.x, y.y FROM range(10) x(x), range(10) y(y)) t ON p.x=greatest(0,least(7,t.x-1)) AND p.y=greatest(0,least(7,t.y-1))", lambda p: N.extrude(p, 8, 8).drop("sprite_id"), X.emb_gray)

_TAP = "k AS (SELECT * FROM (VALUES (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)) t(dx,dy,wt)), t AS (SELECT p.image_id, p.x AS tx, p.y AS ty, k.wt, q.r, q.g, q.b, q.a FROM emb_rgba p, k JOIN emb_rgba q ON true WHERE q.image_id=p.image_id AND q.x=greatest(0,least(7,p.x+k.dx)) AND q.y=greatest(0,least(7,p.y+k.dy)))"
_SUM = ", ".join(f"coalesce(sum(CASE WHEN a>0 THEN {c}*wt ELSE 0 END)//nullif(16-sum(CASE WHEN a>0 THEN 0 ELSE wt END),0),0) AS {c}" for c in "rgb")
_simple("convolve", f"WITH {_TAP}, s AS (SELECT image_id, tx AS x, ty AS y, {_SUM}, sum(a*wt)//16 AS a FROM t GROUP BY image_id, tx, ty) SELECT image_id, x, y, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(a AS BIGINT) AS a FROM s", lambda p: N.convolve(p, 8, 8, [[1, 2, 1], [2, 4, 2], [1, 2, 1]]))
_simple("median_blur", "WITH k AS (SELECT i.i AS dx, j.j AS dy FROM range(-1,2) i(i), range(-1,2) j(j)), t AS (SELECT p.image_id, p.x, p.y, q.v FROM emb_gray p, k JOIN emb_gray q ON true WHERE q.image_id=p.image_id AND q.x=greatest(0,least(7,p.x+k.dx)) AND q.y=greatest(0,least(7,p.y+k.dy))), n AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY v) AS k FROM t) SELECT image_id, x, y, v FROM n WHERE k=5", lambda p: N.median_blur(p, 8, 8), X.emb_gray)
_simple("outline", "SELECT p.image_id, p.x, p.y, CASE WHEN hit THEN 9 ELSE r END AS r, g, b, CASE WHEN hit THEN 255 ELSE a END AS a FROM (SELECT p.*, a=0 AND EXISTS (SELECT 1 FROM emb_rgba q WHERE q.image_id=p.image_id AND q.a>0 AND abs(q.x-p.x)+abs(q.y-p.y)=1) AS hit FROM emb_rgba p) p", lambda p: N.outline(p, {"r": 9, "a": 255}))

_NEIGH = "m AS (SELECT image_id, x, y FROM emb_gray WHERE v>=120), k AS (SELECT i.i AS dx, j.j AS dy FROM range(-1,2) i(i), range(-1,2) j(j)), s AS (SELECT image_id, x+dx AS x, y+dy AS y, count(*) AS n FROM m, k GROUP BY ALL)"
_mask = lambda p: p.filter("v >= 120").select("image_id", "x", "y")
_simple("modify_selection_expand", f"WITH {_NEIGH} SELECT image_id, x, y FROM s", lambda p: N.modify_selection(_mask(p), 1, "expand"), X.emb_gray)
_simple("modify_selection_contract", f"WITH {_NEIGH} SELECT image_id, x, y FROM s WHERE n=9", lambda p: N.modify_selection(_mask(p), 1, "contract"), X.emb_gray)
_simple("selection_stroke", f"WITH {_NEIGH} SELECT m.image_id, m.x, m.y FROM m LEFT JOIN s ON s.image_id=m.image_id AND s.x=m.x AND s.y=m.y WHERE s.n<9", lambda p: N.modify_selection(_mask(p), 1, "border"), X.emb_gray)
_simple("remove_orphans", "WITH q AS (SELECT image_id, x, y, v//16 AS v FROM emb_gray), t AS (SELECT p.image_id, p.x, p.y, p.v AS own, n.v, abs(n.x-p.x)+abs(n.y-p.y)=1 AS close FROM q p JOIN q n ON n.image_id=p.image_id AND abs(n.x-p.x)<=1 AND abs(n.y-p.y)<=1 AND NOT (n.x=p.x AND n.y=p.y)), c AS (SELECT image_id, x, y, own, v, count(*) AS n, bool_or(close AND v=own) AS l FROM t GROUP BY image_id, x, y, own, v), w AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, v) AS k, bool_or(l) OVER (PARTITION BY image_id, x, y) AS alike FROM c) SELECT image_id, x, y, CASE WHEN NOT alike AND n>=4 THEN v ELSE own END AS v FROM w WHERE k=1", lambda p: N.remove_orphans(p.select("image_id", "x", "y", F.floor(F.col("v") / 16).alias("v")), 8, 8), X.emb_gray)
_simple("scale2x", "WITH q AS (SELECT image_id, x, y, v//64 AS v FROM emb_gray), n AS (SELECT p.image_id, p.x, p.y, p.v, coalesce(u.v,p.v) AS u, coalesce(d.v,p.v) AS d, coalesce(l.v,p.v) AS l, coalesce(r.v,p.v) AS r FROM q p LEFT JOIN q u ON u.image_id=p.image_id AND u.x=p.x AND u.y=p.y-1 LEFT JOIN q d ON d.image_id=p.image_id AND d.x=p.x AND d.y=p.y+1 LEFT JOIN q l ON l.image_id=p.image_id AND l.x=p.x-1 AND l.y=p.y LEFT JOIN q r ON r.image_id=p.image_id AND r.x=p.x+1 AND r.y=p.y) SELECT image_id, x*2 AS x, y*2 AS y, CASE WHEN l=u AND l<>d AND u<>r THEN l ELSE v END AS v FROM n UNION ALL SELECT image_id, x*2+1, y*2, CASE WHEN u=r AND u<>l AND r<>d THEN u ELSE v END FROM n UNION ALL SELECT image_id, x*2, y*2+1, CASE WHEN d=l AND d<>r AND l<>u THEN d ELSE v END FROM n UNION ALL SELECT image_id, x*2+1, y*2+1, CASE WHEN r=d AND r<>u AND d<>l THEN r ELSE v END FROM n", lambda p: N.scale2x(p.select("image_id", "x", "y", F.floor(F.col("v") / 64).alias("v"))), X.emb_gray)
_simple("pixel_runs", "SELECT image_id, y, min(x) AS x1, max(x) AS x2 FROM (SELECT *, x-row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS i FROM emb_gray WHERE v>=120) GROUP BY image_id, y, i", lambda p: N.pixel_runs(_mask(p)), X.emb_gray)
_simple("edge_signal", "SELECT image_id, 'x' AS axis, x AS at, round(avg(d),6) AS signal FROM (SELECT p.image_id, p.x, abs(p.v-q.v) AS d FROM emb_gray p JOIN emb_gray q ON q.image_id=p.image_id AND q.x=p.x-1 AND q.y=p.y) GROUP BY image_id, x UNION ALL SELECT image_id, 'y', y, round(avg(d),6) FROM (SELECT p.image_id, p.y, abs(p.v-q.v) AS d FROM emb_gray p JOIN emb_gray q ON q.image_id=p.image_id AND q.y=p.y-1 AND q.x=p.x) GROUP BY image_id, y", lambda p: N.edge_signal(p).withColumn("signal", F.round("signal", 6)), X.emb_gray)
_simple("cell_median_resample", "SELECT image_id, x//4 AS u, y//4 AS w, CAST(floor(median(v)) AS BIGINT) AS v FROM emb_gray GROUP BY image_id, x//4, y//4", lambda p: N.cell_medians(p, 4), X.emb_gray)
_simple("border_model_flat", "WITH e AS (SELECT image_id, v//32 AS v, count(*) AS n FROM emb_gray WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY image_id, v//32) SELECT * FROM (SELECT image_id, v, n, round(n/sum(n) OVER (PARTITION BY image_id),6) AS share, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, v) AS place FROM e) WHERE place<=12 AND share>=0.004", lambda p: N.border_shares(p.withColumn("v", F.floor(F.col("v") / 32)), 8, 8, channels=("v",)).withColumn("share", F.round("share", 6)), X.emb_gray)
_simple("border_model_gradient", "WITH e AS (SELECT * FROM emb_gray WHERE x=0 OR y=0 OR x=7 OR y=7), s AS (SELECT image_id, regr_slope(v, x) AS q, regr_slope(v, y) AS r, avg(v) AS m FROM e GROUP BY image_id) SELECT e.image_id, CAST(floor(1000*min(q)+0.5+1e-6) AS BIGINT) AS q1000, CAST(floor(1000*min(r)+0.5+1e-6) AS BIGINT) AS r1000, CAST(floor(1000*sqrt(avg(pow(v-m-q*(x-3.5)-r*(y-3.5), 2)))+0.5+1e-6) AS BIGINT) AS rms1000 FROM e JOIN s ON s.image_id=e.image_id GROUP BY e.image_id", lambda p: N.plane_error(N.border(p, 8, 8), N.plane_fit(N.border(p, 8, 8))).select("image_id", *(F.floor(1000 * F.col(c) + 0.5 + 1e-6).cast("long").alias(f"{c}1000") for c in ("q", "r", "rms"))), X.emb_gray)


@query("bg_remove", "WITH e AS (SELECT image_id, r, g, b, count(*) AS n FROM emb_rgba WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY image_id, r, g, b), m AS (SELECT image_id, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM e) WHERE k<=2) SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.image_id=p.image_id AND abs(m.r-p.r)<=10 AND abs(m.g-p.g)<=10 AND abs(m.b-p.b)<=10) THEN 0 ELSE p.a END AS a FROM emb_rgba p")
def bg_remove(spark, d):
    p = X.emb_rgba(spark, d)
    model = N.border_shares(p, 8, 8, channels=("r", "g", "b"), least=0.0, most=2).select("image_id", *(F.col(c).alias(f"m{c}") for c in "rgb"))
    return N.background_flat(p, model, 10)


@query("gradient_fill", "SELECT image_id, x, y, CAST(floor(10+200*x/7.0+1e-9) AS BIGINT) AS r, CAST(floor(250-240*x/7.0+1e-9) AS BIGINT) AS g FROM emb_gray")
def gradient_fill(spark, d):
    return N.gradient(X.emb_gray(spark, d).select("image_id", "x", "y"), 8, {"r": 10, "g": 250}, {"r": 210, "g": 10})


@query("bayer_matrix", "SELECT image_id, x, y, [0,2,3,1][1+(y%2)*2+x%2]*4 + [0,2,3,1][1+((y//2)%2)*2+(x//2)%2] AS rough FROM emb_gray")
def bayer_matrix(spark, d):
    return X.emb_gray(spark, d).select("image_id", "x", "y", N.matrix_at(N.bayer(4)).alias("rough"))


_simple("dither_ordered", "WITH m AS (SELECT image_id, x, y, v, [0,2,3,1][1+(y%2)*2+x%2]*4 + [0,2,3,1][1+((y//2)%2)*2+(x//2)%2] AS t, v*3//255 AS low FROM emb_gray) SELECT image_id, x, y, low + CASE WHEN (v*3-low*255)*16 > t*255+127 THEN 1 ELSE 0 END AS level FROM m", lambda p: N.dither_levels(p, 4, N.bayer(4)).select("image_id", "x", "y", "level"), X.emb_gray)

_FRAMES = "c AS (SELECT conv_id AS sprite_id, turn//3 AS frame, turn%3 AS layer, row_number() OVER (PARTITION BY conv_id, turn//3 ORDER BY turn%3+((conv_id+turn)%3-1), (conv_id+turn)%3-1, turn%3)-1 AS place, 255-16*turn AS opacity, turn FROM conversations), px AS (SELECT a.sprite_id, a.frame//3 AS frame, a.frame%3 AS layer, a.x, a.y, a.r, a.g, a.b, a.a FROM anim_rgba a WHERE a.a>0), l AS (SELECT px.*, c.place, c.opacity FROM px JOIN c ON c.sprite_id=px.sprite_id AND c.frame=px.frame AND c.layer=px.layer)"


def _un8(a, b):
    return f"((((({a})*({b})+128)>>8)+({a})*({b})+128)>>8)"


def _fold(rows="l", out="f", places=(0, 1, 2), modes=None):
    """The places of a table, back to front: each step composes the next place's pixel over what is there.

    modes: SQL of a mode's number for the source s, and the modes by number; without them, all are normal.
    """
    steps, before = [], f"(SELECT DISTINCT sprite_id, frame, x, y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM {rows})"
    for k, place in enumerate(places):
        sa = _un8("coalesce(s.a,0)", "coalesce(s.opacity,0)")
        ra = f"({sa}+z.a-{_un8('z.a', sa)})"
        toned = lambda c: f"s.{c}" if modes is None else f"(CASE {modes[0]} " + " ".join(f"WHEN {i} THEN {_sql_modes()[m](f'z.{c}', f's.{c}')}" for i, m in enumerate(modes[1])) + " END)"
        cols = ", ".join(f"CASE WHEN z.a=0 THEN coalesce(s.{c},0) WHEN {sa}=0 THEN z.{c} ELSE z.{c}+(({toned(c)}-z.{c})*{sa})//nullif({ra},0) END AS {c}" for c in "rgb")
        steps.append(f"{out}{k} AS (SELECT z.sprite_id, z.frame, z.x, z.y, {cols}, CASE WHEN z.a=0 THEN {sa} WHEN {sa}=0 THEN z.a ELSE {ra} END AS a FROM {before} z LEFT JOIN {rows} s ON s.sprite_id=z.sprite_id AND s.frame=z.frame AND s.x=z.x AND s.y=z.y AND s.place={place})")
        before = f"{out}{k}"
    return ", ".join(steps)


def _cels(spark, d):
    turn = F.col("turn")
    cels = X.table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.floor(turn / 3).alias("frame"), (turn % 3).alias("layer"), ((F.col("conv_id") + turn) % 3 - 1).alias("z"), (255 - 16 * turn).cast("int").alias("opacity"), F.lit("normal").alias("mode"))
    pixels = X.anim_rgba(spark, d).select("sprite_id", F.floor(F.col("frame") / 3).alias("frame"), (F.col("frame") % 3).alias("layer"), "x", "y", *"rgba")
    return cels, pixels


@query("flatten", f"WITH {_FRAMES}, {_fold()} SELECT sprite_id, frame, x, y, r, g, b, a FROM f2 WHERE a>0")
def flatten(spark, d):
    from spritespark.operators.structure import render_order

    cels, pixels = _cels(spark, d)
    return N.flatten(pixels.join(render_order(cels, ["sprite_id", "frame"]), ["sprite_id", "frame", "layer"]))


_EXPORT = "v AS (SELECT * FROM f2 WHERE a>0), bx AS (SELECT sprite_id, frame, min(x) AS x0, min(y) AS y0, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h FROM v GROUP BY sprite_id, frame), hs AS (SELECT v.sprite_id, v.frame, string_agg((v.x-x0) || ':' || (v.y-y0) || ':' || r || ':' || g || ':' || b || ':' || a, ',' ORDER BY v.y, v.x) AS s FROM v JOIN bx ON bx.sprite_id=v.sprite_id AND bx.frame=v.frame GROUP BY v.sprite_id, v.frame), o AS (SELECT sprite_id, frame, min(frame) OVER (PARTITION BY sprite_id, s) AS original FROM hs), it AS (SELECT bx.sprite_id, bx.frame, o.original, w, h FROM bx JOIN o ON o.sprite_id=bx.sprite_id AND o.frame=bx.frame), n AS (SELECT *, (row_number() OVER (PARTITION BY sprite_id ORDER BY frame)-1)//3 AS band FROM it WHERE frame=original), bm AS (SELECT sprite_id, band, max(h) AS most FROM n GROUP BY sprite_id, band), bo AS (SELECT sprite_id, band, coalesce(sum(most+1) OVER (PARTITION BY sprite_id ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS y FROM bm), sl AS (SELECT n.sprite_id, n.frame, coalesce(sum(w+1) OVER (PARTITION BY n.sprite_id, n.band ORDER BY n.frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS x, bo.y FROM n JOIN bo ON bo.sprite_id=n.sprite_id AND bo.band=n.band)"


@query("sheet_export", f"WITH {_FRAMES}, {_fold()}, {_EXPORT} SELECT it.sprite_id, it.frame, it.original, CAST(sl.x AS BIGINT) AS x, CAST(sl.y AS BIGINT) AS y, it.w, it.h FROM it JOIN sl ON sl.sprite_id=it.sprite_id AND sl.frame=it.original")
def sheet_export(spark, d):
    return export_sheet(*_cels(spark, d))


#: The modes that are exact in whole numbers.
_EXACT = [m for m in SEPARABLE if m != "soft_light"]


@query("flatten_modes", f"WITH {_FRAMES}, {_fold(modes=(f'(s.sprite_id+5*s.place)%{len(_EXACT)}', _EXACT))} SELECT sprite_id, frame, x, y, r, g, b, a FROM f2 WHERE a>0")
def flatten_modes(spark, d):
    """A mode for each sprite and place."""
    from spritespark.operators.structure import render_order

    cels, pixels = _cels(spark, d)
    mode = F.element_at(F.array(*map(F.lit, _EXACT)), ((F.col("sprite_id") + 5 * F.col("place")) % len(_EXACT) + 1).cast("int"))
    return N.flatten(shuffled(pixels).join(render_order(cels, ["sprite_id", "frame"]).withColumn("mode", mode), ["sprite_id", "frame", "layer"]))


_GROUPS = f"{_FRAMES}, below AS (SELECT * EXCLUDE (place), layer AS place FROM l WHERE layer=0), above AS (SELECT * EXCLUDE (place), layer AS place FROM l WHERE layer>0), {_fold('below', 'ga', (0,))}, {_fold('above', 'gb', (1, 2))}, gs AS (SELECT *, 0 AS place, 128 AS opacity FROM ga0 WHERE a>0 UNION ALL SELECT *, 1, 200 FROM gb1 WHERE a>0), {_fold('gs', 'gz', (0, 1), ('s.place', ['normal', 'multiply']))}"


@query("compose_groups_stacked", f"WITH {_GROUPS} SELECT sprite_id, frame, x, y, r, g, b, a FROM gz1 WHERE a>0")
def compose_groups_stacked(spark, d):
    """The lowest layer alone, the two above it as a group that multiplies it."""
    cels, pixels = _cels(spark, d)
    p = pixels.join(cels.drop("z"), ["sprite_id", "frame", "layer"]).withColumns({"place": F.col("layer"), "group_id": F.when(F.col("layer") == 0, 0).otherwise(1)})
    groups = spark.createDataFrame([(0, 0, 128, "normal"), (1, 1, 200, "multiply")], "group_id int, place int, opacity int, mode string")
    return N.compose_groups(p.drop("layer"), groups)


_LUMA = "(r*2126+g*7152+b*722)//10000"
_GHOSTS = "g AS (SELECT p.sprite_id, p.frame+k.k AS frame, x, y, k.k, k.place, k.opacity, {rgb}, a FROM anim_rgba p, (VALUES (2,-2,80),(1,-1,128),(-1,1,128),(0,2,255)) k(k,place,opacity) WHERE a>0), l AS (SELECT g.* FROM g JOIN (SELECT DISTINCT sprite_id, frame FROM anim) f ON f.sprite_id=g.sprite_id AND f.frame=g.frame)"
_TINTED = f"CASE WHEN k.k=0 THEN r WHEN k.k>0 THEN (255+{_LUMA})//2 ELSE {_LUMA}//2 END AS r, CASE WHEN k.k=0 THEN g ELSE {_LUMA}//2 END AS g, CASE WHEN k.k=0 THEN b WHEN k.k<0 THEN (255+{_LUMA})//2 ELSE {_LUMA}//2 END AS b"

for _name, _rgb, _tint in (("onion_skin", "r, g, b", False), ("onion_skin_tint", _TINTED, True)):
    query(_name, f"WITH {_GHOSTS.format(rgb=_rgb)}, {_fold(places=(-2, -1, 1, 2))} SELECT sprite_id, frame, x, y, r, g, b, a FROM f3 WHERE a>0")(lambda spark, d, tint=_tint: N.onion_skin(X.anim_rgba(spark, d).drop("layer", "idx"), 2, 128, 48, after=1, tint=tint))
