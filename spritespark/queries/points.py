"""Point operators and counts over the projections."""

from pyspark.sql import functions as F

from spritespark.functions import color as C
from spritespark.functions.blend import SEPARABLE, blend_rgba, destination_over
from spritespark.operators import points as P
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X


@query("pack_unpack", "SELECT image_id, x, y, r + g*256 + b*65536 + CAST(a AS BIGINT)*16777216 AS rgba, v + a*256 AS graya, (x*8+y) + CASE WHEN x%2=1 THEN 2147483648 ELSE 0 END + CASE WHEN y%2=1 THEN 1073741824 ELSE 0 END + CASE WHEN x=y THEN 536870912 ELSE 0 END AS tile, r AS r2, g AS g2, b AS b2, a AS a2 FROM emb_rgba JOIN emb_gray USING (image_id, x, y)")
def pack_unpack(spark, d):
    p = X.emb_rgba(spark, d).withColumn("v", F.col("r")).withColumn("c", C.pack_rgba())
    return p.select("image_id", "x", "y", F.col("c").alias("rgba"), C.pack_graya().alias("graya"), C.pack_tile(F.col("x") * 8 + F.col("y"), F.col("x") % 2 == 1, F.col("y") % 2 == 1, F.col("x") == F.col("y")).alias("tile"), *(c.alias(f"{n}2") for n, c in zip("rgba", C.unpack_rgba(), strict=True)))


@query("to_gray", "SELECT image_id, x, y, (r*2126+g*7152+b*722)//10000 AS luma, greatest(r,g,b) AS value, (greatest(r,g,b)+least(r,g,b))//2 AS lightness FROM emb_rgba")
def to_gray(spark, d):
    return X.emb_rgba(spark, d).select("image_id", "x", "y", C.luma().alias("luma"), C.hsv_max().alias("value"), C.hsl_mid().alias("lightness"))


@query("scale_bits", "SELECT image_id, x, y, ((v>>5)<<5)|((v>>5)<<2)|((v>>5)>>1) AS s3, ((v>>3)<<3)|((v>>3)>>2) AS s5, ((v>>2)<<2)|((v>>2)>>4) AS s6 FROM emb_gray")
def scale_bits(spark, d):
    return X.emb_gray(spark, d).select("image_id", "x", "y", *(C.scale_bits(F.shiftright("v", 8 - n), n).alias(f"s{n}") for n in (3, 5, 6)))


@query("oklab", "WITH n AS (SELECT image_id, x, y, CASE WHEN r/255.0::DOUBLE <= 0.04045 THEN r/255.0::DOUBLE/12.92 ELSE pow((r/255.0::DOUBLE+0.055)/1.055, 2.4) END AS r, CASE WHEN g/255.0::DOUBLE <= 0.04045 THEN g/255.0::DOUBLE/12.92 ELSE pow((g/255.0::DOUBLE+0.055)/1.055, 2.4) END AS g, CASE WHEN b/255.0::DOUBLE <= 0.04045 THEN b/255.0::DOUBLE/12.92 ELSE pow((b/255.0::DOUBLE+0.055)/1.055, 2.4) END AS b FROM emb_rgba), l AS (SELECT image_id, x, y, cbrt(0.4122214708::DOUBLE*r+0.5363325363::DOUBLE*g+0.0514459929::DOUBLE*b) AS l, cbrt(0.2119034982::DOUBLE*r+0.6806995451::DOUBLE*g+0.1073969566::DOUBLE*b) AS m, cbrt(0.0883024619::DOUBLE*r+0.2817188376::DOUBLE*g+0.6299787005::DOUBLE*b) AS s FROM n) SELECT image_id, x, y, CAST(round(1000*(0.2104542553::DOUBLE*l+0.7936177850::DOUBLE*m-0.0040720468::DOUBLE*s)) AS BIGINT) AS l, CAST(round(1000*(1.9779984951::DOUBLE*l-2.4285922050::DOUBLE*m+0.4505937099::DOUBLE*s)) AS BIGINT) AS a, CAST(round(1000*(0.0259040371::DOUBLE*l+0.7827717662::DOUBLE*m-0.8086757660::DOUBLE*s)) AS BIGINT) AS b FROM l")
def oklab(spark, d):
    return X.emb_rgba(spark, d).select("image_id", "x", "y", *(F.round(1000 * c).cast("long").alias(n) for n, c in zip("lab", C.oklab(), strict=True)))


@query("invert", "SELECT image_id, x, y, 255-r AS r, 255-g AS g, 255-b AS b, a FROM emb_rgba")
def invert(spark, d):
    return P.invert(X.emb_rgba(spark, d))


_BC = "CAST(floor(255.5*greatest(0, least(1, greatest(0, least(1, 1.25*({c}/255.0::DOUBLE-0.5)+0.5))*1.125))) AS BIGINT) AS {c}"


@query("brightness_contrast", f"SELECT image_id, x, y, {', '.join(_BC.format(c=c) for c in 'rgb')}, a FROM emb_rgba")
def brightness_contrast(spark, d):
    return P.brightness_contrast(X.emb_rgba(spark, d), 0.125, 0.25)


_CURVE = "CASE WHEN {c} < 32 THEN 0 WHEN {c} < 160 THEN CAST(trunc(200*({c}-32)/128.0) AS BIGINT) WHEN {c} < 224 THEN CAST(trunc(200+40*({c}-160)/64.0) AS BIGINT) ELSE 240 END AS {c}"


@query("color_curve", f"SELECT image_id, x, y, {', '.join(_CURVE.format(c=c) for c in 'rgb')}, a FROM emb_rgba")
def color_curve(spark, d):
    return P.color_curve(X.emb_rgba(spark, d), [(32, 0), (160, 200), (224, 240)])


@query("replace_color", "SELECT image_id, x, y, CASE WHEN abs(r-128)<=20 AND abs(g-128)<=60 - 40 THEN 255 ELSE r END AS r, g, CASE WHEN abs(r-128)<=20 AND abs(g-128)<=20 THEN 0 ELSE b END AS b, a FROM emb_rgba")
def replace_color(spark, d):
    return P.replace_color(X.emb_rgba(spark, d), {"r": 128, "g": 128}, {"r": 255, "b": 0}, 20)


@query("channel_target", "SELECT p.image_id, p.x, p.y, CASE WHEN m.x IS NULL THEN r ELSE 255-r END AS r, g, CASE WHEN m.x IS NULL THEN b ELSE 255-b END AS b, a FROM emb_rgba p LEFT JOIN (SELECT image_id, x, y FROM emb_rgba WHERE g > 100) m ON p.image_id=m.image_id AND p.x=m.x AND p.y=m.y")
def channel_target(spark, d):
    p = X.emb_rgba(spark, d)
    return P.on_channels(p, lambda c: 255 - c, ("r", "b"), p.filter("g > 100"))


@query("udf_pixel_map", "SELECT image_id, x, y, g AS r, b AS g, r AS b, 255 AS a FROM emb_rgba")
def udf_pixel_map(spark, d):
    return P.transform_pixels(X.emb_rgba(spark, d), lambda c: {"r": c["g"], "g": c["b"], "b": c["r"], "a": F.lit(255)})


_HSV = "c AS (SELECT *, r/255.0::DOUBLE AS x1, g/255.0::DOUBLE AS x2, b/255.0::DOUBLE AS x3, greatest(r,g,b)/255.0::DOUBLE AS most, least(r,g,b)/255.0::DOUBLE AS low FROM emb_rgba), h AS (SELECT *, 60*CASE WHEN most=low THEN 0.0::DOUBLE WHEN most=x1 THEN (x2-x3)/(most-low) WHEN most=x2 THEN (x3-x1)/(most-low)+2 ELSE (x1-x2)/(most-low)+4 END AS hue FROM c), k AS (SELECT image_id, x, y, a, ((CASE WHEN hue<0 THEN hue+360 ELSE hue END)+90)%360/60 AS hue, least(1.0::DOUBLE, most*1.125) AS v, CASE WHEN most>0 THEN 0.75*(most-low)/most ELSE 0.0::DOUBLE END AS s FROM h)"
_HUED = ", ".join(f"CASE WHEN a=0 THEN 0 ELSE CAST(floor(255*(v-v*s*greatest(0.0::DOUBLE, least(({n}+hue)%6, 4-({n}+hue)%6, 1.0::DOUBLE)))+0.5+1e-9) AS BIGINT) END AS {c}" for c, n in (("r", 5), ("g", 3), ("b", 1)))


@query("hue_saturation", f"WITH {_HSV} SELECT image_id, x, y, {_HUED}, a FROM k")
def hue_saturation(spark, d):
    return P.hue_saturation(X.emb_rgba(spark, d), hue=90.0, saturation=-0.25, value=0.125)


@query("mask_by_color", "SELECT image_id, x, y FROM emb_rgba WHERE abs(r-128)<=16 AND abs(b-127)<=16")
def mask_by_color(spark, d):
    return P.mask_by_color(X.emb_rgba(spark, d), {"r": 128, "b": 127}, 16)


@query("mask_from_alpha", "SELECT image_id, x, y FROM emb_rgba WHERE a > 0")
def mask_from_alpha(spark, d):
    return P.mask_from_alpha(X.emb_rgba(spark, d))


@query("chroma_key", "WITH k AS (SELECT *, sqrt(CAST((r-128)*(r-128)+(g-200)*(g-200)+(b-127)*(b-127) AS DOUBLE)) AS d FROM emb_rgba), s AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (d-0.45::DOUBLE*120)/(0.6::DOUBLE*120))) AS s FROM k) SELECT image_id, x, y, r, CASE WHEN s<1 THEN least(g, greatest(r,b)) ELSE g END AS g, b, CAST(floor(a*s+0.5) AS BIGINT) AS a FROM s")
def chroma_key(spark, d):
    return P.chroma_key(X.emb_rgba(spark, d), {"r": 128, "g": 200, "b": 127}, 120.0)


def _un8(a, b):
    return f"((((({a})*({b})+128)>>8)+({a})*({b})+128)>>8)"


def _du8(a, b):
    return f"((({a})*255+(({b})>>1))//nullif({b},0))"


def _sql_modes():
    screen = lambda b, s: f"(({b})+({s})-{_un8(b, s)})"
    hard = lambda b, s: f"(CASE WHEN ({s})<128 THEN {_un8(b, f'({s})*2')} ELSE {screen(b, f'(({s})*2-255)')} END)"
    return {
        "normal": lambda b, s: s, "multiply": _un8, "screen": screen, "overlay": lambda b, s: hard(s, b), "darken": lambda b, s: f"least({b},{s})", "lighten": lambda b, s: f"greatest({b},{s})",
        "color_dodge": lambda b, s: f"(CASE WHEN {b}=0 THEN 0 WHEN {b}>=255-{s} THEN 255 ELSE {_du8(b, f'(255-{s})')} END)", "color_burn": lambda b, s: f"(CASE WHEN {b}=255 THEN 255 WHEN 255-{b}>={s} THEN 0 ELSE 255-{_du8(f'(255-{b})', s)} END)",
        "hard_light": hard, "soft_light": lambda b, s: f"CAST(floor(0.5+255*(CASE WHEN {s}/255.0::DOUBLE<=0.5 THEN {b}/255.0::DOUBLE-(1-2*{s}/255.0::DOUBLE)*({b}/255.0::DOUBLE)*(1-{b}/255.0::DOUBLE) ELSE {b}/255.0::DOUBLE+(2*{s}/255.0::DOUBLE-1)*((CASE WHEN {b}/255.0::DOUBLE<=0.25 THEN ((16*{b}/255.0::DOUBLE-12)*{b}/255.0::DOUBLE+4)*{b}/255.0::DOUBLE ELSE sqrt({b}/255.0::DOUBLE) END)-{b}/255.0::DOUBLE) END)) AS BIGINT)",
        "difference": lambda b, s: f"abs({b}-{s})", "exclusion": lambda b, s: f"({b}+{s}-2*{_un8(b, s)})", "addition": lambda b, s: f"least({b}+{s},255)", "subtract": lambda b, s: f"greatest({b}-{s},0)", "divide": lambda b, s: f"(CASE WHEN {b}=0 THEN 0 WHEN {b}>={s} THEN 255 ELSE {_du8(b, s)} END)",
    }


_PAIR = "pair AS (SELECT p.image_id, p.x, p.y, p.r AS br, p.g AS bg, p.b AS bb, p.a AS ba, q.r AS sr, q.g AS sg, q.b AS sb, q.a AS sa FROM emb_rgba p JOIN emb_rgba q ON q.image_id = p.image_id AND q.x = 7 - p.x AND q.y = p.y)"


def _pair(spark, d):
    p = X.emb_rgba(spark, d)
    b = p.select("image_id", "x", "y", *(F.col(c).alias(f"b{c}") for c in "rgba"))
    s = p.select("image_id", (7 - F.col("x")).alias("x"), "y", *(F.col(c).alias(f"s{c}") for c in "rgba"))
    return b.join(s, ["image_id", "x", "y"])


def _over_sql(mixed, opacity):
    sa = _un8("sa", str(opacity))
    ra = f"({sa}+ba-{_un8('ba', sa)})"
    src = [f"(CASE WHEN ba=0 THEN s{c} ELSE {m} END)" for c, m in zip("rgb", mixed, strict=True)]
    out = [f"(CASE WHEN ba=0 THEN {s} WHEN {sa}=0 THEN b{c} ELSE b{c}+(({s}-b{c})*{sa})//nullif({ra},0) END) AS {c}" for c, s in zip("rgb", src, strict=True)]
    return ", ".join([*out, f"(CASE WHEN ba=0 THEN {sa} WHEN {sa}=0 THEN ba ELSE {ra} END) AS a"])


def _toned_sql(mode):
    """CTEs from pair to tone (its columns and m1, m2, m3): a colour given another's luminosity, cut to 0..1 by its own."""
    lum = lambda c: f"(0.3::DOUBLE*{c}1+0.59::DOUBLE*{c}2+0.11::DOUBLE*{c}3)"
    low, high = (lambda c: f"least({c}1,{c}2,{c}3)"), (lambda c: f"greatest({c}1,{c}2,{c}3)")
    of, to, given = {"hue": ("s", "b", "b"), "saturation": ("b", "s", "b"), "color": ("s", None, "b"), "luminosity": ("b", None, "s")}[mode]
    each = lambda f: ", ".join(f(i) for i in (1, 2, 3))
    spread = (lambda i: f"CASE WHEN {high(of)}>{low(of)} THEN ({of}{i}-{low(of)})*({high(to)}-{low(to)})/({high(of)}-{low(of)}) ELSE 0.0::DOUBLE END AS c{i}") if to else (lambda i: f"{of}{i} AS c{i}")
    unit = ", ".join(f"{side}{c}/255.0::DOUBLE AS {side}{i}" for side in "bs" for i, c in enumerate("rgb", 1))
    return (
        f"n AS (SELECT *, {unit} FROM pair), o AS (SELECT *, {each(spread)} FROM n), p AS (SELECT *, {each(lambda i: f'c{i}+({lum(given)}-{lum("c")}) AS e{i}')} FROM o), "
        f"q AS (SELECT *, {each(lambda i: f'CASE WHEN {low("e")}<0 THEN {lum("e")}+(e{i}-{lum("e")})*{lum("e")}/nullif({lum("e")}-{low("e")},0) ELSE e{i} END AS f{i}')} FROM p), "
        f"tone AS (SELECT *, {each(lambda i: f'CAST(floor(255*greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {high("f")}>1 THEN {lum("f")}+(f{i}-{lum("f")})*(1-{lum("f")})/nullif({high("f")}-{lum("f")},0) ELSE f{i} END))+1e-9) AS BIGINT) AS m{i}')} FROM q)"
    )


def _register_blends():
    for mode, f in _sql_modes().items():
        sql = f"WITH {_PAIR} SELECT image_id, x, y, {_over_sql([f(f'b{c}', f's{c}') for c in 'rgb'], 200)} FROM pair"
        assert mode in SEPARABLE

        def run(spark, d, mode=mode):
            r = blend_rgba(mode, ["br", "bg", "bb", "ba"], ["sr", "sg", "sb", "sa"], 200)
            return _pair(spark, d).select("image_id", "x", "y", *(c.alias(n) for c, n in zip(r, "rgba", strict=True)))

        query(f"blend_{mode}", sql)(run)
    for mode in ("hue", "saturation", "color", "luminosity"):

        def run_hsl(spark, d, mode=mode):
            r = blend_rgba(mode, ["br", "bg", "bb", "ba"], ["sr", "sg", "sb", "sa"], 255)
            return _pair(spark, d).select("image_id", "x", "y", *(c.alias(n) for c, n in zip(r, "rgba", strict=True)))

        query(f"blend_{mode}", f"WITH {_PAIR}, {_toned_sql(mode)} SELECT image_id, x, y, {_over_sql(['m1', 'm2', 'm3'], 255)} FROM tone")(run_hsl)


_register_blends()


@query("checkered_bg", "SELECT image_id, x, y, CASE WHEN a=0 THEN CASE WHEN (x//2+y//2)%2=0 THEN 128 ELSE 192 END ELSE r END AS r, CASE WHEN a=0 THEN CASE WHEN (x//2+y//2)%2=0 THEN 128 ELSE 192 END ELSE g END AS g, CASE WHEN a=0 THEN CASE WHEN (x//2+y//2)%2=0 THEN 128 ELSE 192 END ELSE b END AS b, 255 AS a FROM emb_rgba")
def checkered_bg(spark, d):
    shade = F.when((F.floor(F.col("x") / 2) + F.floor(F.col("y") / 2)) % 2 == 0, 128).otherwise(192)
    r = destination_over(["r", "g", "b", "a"], [shade, shade, shade, F.lit(255)])
    return X.emb_rgba(spark, d).select("image_id", "x", "y", *(c.alias(n) for c, n in zip(r, "rgba", strict=True)))


@query("color_histogram", "SELECT sprite_id, r, g, b, a, count(*) AS n FROM anim_rgba WHERE a > 0 GROUP BY ALL")
def color_histogram(spark, d):
    return P.color_histogram(X.anim_rgba(spark, d), ("sprite_id",))


@query("color_histogram_rollup", "SELECT sprite_id, frame, layer, idx, count(*) AS n FROM anim GROUP BY GROUPING SETS ((idx), (sprite_id, idx), (sprite_id, frame, idx), (sprite_id, frame, layer, idx))")
def color_histogram_rollup(spark, d):
    p = X.anim(spark, d)
    return p.groupingSets([[p.idx], [p.sprite_id, p.idx], [p.sprite_id, p.frame, p.idx], [p.sprite_id, p.frame, p.layer, p.idx]], p.sprite_id, p.frame, p.layer, p.idx).agg(F.count("*").alias("n"))


@query("binned_histogram", "SELECT sprite_id, r>>3 AS r, g>>2 AS g, b>>3 AS b, a>>3 AS a, count(*) AS n FROM anim_rgba GROUP BY ALL")
def binned_histogram(spark, d):
    return P.binned_histogram(X.anim_rgba(spark, d), ("sprite_id",))


@query("distinct_colors", "SELECT image_id, count(DISTINCT idx) AS n, count(DISTINCT idx) <= 64 AS few FROM doc_pixels GROUP BY image_id")
def distinct_colors(spark, d):
    return X.doc_pixels(spark, d).groupBy("image_id").agg(F.count_distinct("idx").alias("n")).withColumn("few", F.col("n") <= 64)


@query("top_colors", "SELECT * FROM (SELECT sprite_id, r, g, b, a, count(*) AS n, row_number() OVER (PARTITION BY sprite_id ORDER BY count(*) DESC, r, g, b, a) AS place FROM anim_rgba WHERE a > 0 GROUP BY sprite_id, r, g, b, a) WHERE place <= 5")
def top_colors(spark, d):
    return P.top_colors(X.anim_rgba(spark, d), 5, ("sprite_id",))


@query("is_plain", "SELECT image_id, count(DISTINCT (r,g,b,a)) = 1 AS plain, max(a) = 0 AS empty FROM emb_rgba GROUP BY image_id")
def is_plain(spark, d):
    return P.is_plain(X.emb_rgba(spark, d))


@query("ignore_empty", "SELECT DISTINCT image_id, y AS row FROM emb_rgba WHERE a > 0")
def ignore_empty(spark, d):
    p = X.emb_rgba(spark, d).withColumn("row", F.col("y"))
    return P.without_empty(p.select("image_id", "row").distinct(), p, ["image_id", "row"])


@query("trim_bounds", "SELECT image_id, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h FROM doc_pixels WHERE idx <> 32 GROUP BY image_id")
def trim_bounds(spark, d):
    return P.trim_bounds(X.with_colors(X.doc_pixels(spark, d)))


@query("trim_sprite_bounds", "WITH t AS (SELECT sprite_id, min(x) AS x, min(y) AS y, max(x)+1 AS x2, max(y)+1 AS y2 FROM anim_rgba WHERE a > 0 GROUP BY sprite_id) SELECT sprite_id, x//8*8 AS x, y//8*8 AS y, (x2+7)//8*8-x//8*8 AS w, (y2+7)//8*8-y//8*8 AS h FROM t")
def trim_sprite_bounds(spark, d):
    return P.snap_out(P.trim_bounds(X.anim_rgba(spark, d), ("sprite_id",)), 8, 8)


@query("image_diff_count", "SELECT p.image_id, count(*) FILTER (WHERE p.r<>q.r OR p.g<>q.g OR p.b<>q.b OR p.a<>q.a) AS n FROM emb_rgba p JOIN emb_rgba q ON p.image_id=q.image_id AND p.x=7-q.x AND p.y=q.y GROUP BY p.image_id")
def image_diff_count(spark, d):
    p = X.emb_rgba(spark, d)
    return P.image_diff_count(p, p.withColumn("x", 7 - F.col("x")))


@query("frame_delta_bounds", "WITH f AS (SELECT DISTINCT sprite_id, frame FROM anim), n AS (SELECT sprite_id, frame, x, y, idx FROM anim WHERE idx <> 32), o AS (SELECT n.sprite_id, n.frame+1 AS frame, x, y, idx AS old FROM n JOIN f ON f.sprite_id=n.sprite_id AND f.frame=n.frame+1), j AS (SELECT coalesce(n.sprite_id,o.sprite_id) AS sprite_id, coalesce(n.frame,o.frame) AS frame, coalesce(n.x,o.x) AS x, coalesce(n.y,o.y) AS y, idx, old FROM n FULL JOIN o ON n.sprite_id=o.sprite_id AND n.frame=o.frame AND n.x=o.x AND n.y=o.y) SELECT sprite_id, min(frame) AS frame, 0 AS x, 0 AS y, max(x)+1 AS w, max(y)+1 AS h, false AS cleared FROM anim GROUP BY sprite_id UNION ALL SELECT sprite_id, frame, min(x), min(y), max(x)-min(x)+1, max(y)-min(y)+1, bool_or(idx IS NULL) FROM j WHERE idx IS DISTINCT FROM old AND frame > (SELECT min(f.frame) FROM f WHERE f.sprite_id=j.sprite_id) GROUP BY sprite_id, frame")
def frame_delta_bounds(spark, d):
    return P.frame_delta(X.anim_rgba(spark, d))


@query("flicker_delta", "WITH h AS (SELECT sprite_id, frame, idx, count(*) AS n FROM anim GROUP BY ALL), f AS (SELECT DISTINCT sprite_id, frame FROM h) SELECT p.sprite_id, p.frame+1 AS frame, round(sum(abs(p.n-coalesce(c.n,0)))/sum(p.n), 6) AS delta FROM h p JOIN f ON f.sprite_id=p.sprite_id AND f.frame=p.frame+1 LEFT JOIN h c ON c.sprite_id=p.sprite_id AND c.frame=p.frame+1 AND c.idx=p.idx GROUP BY p.sprite_id, p.frame")
def flicker_delta(spark, d):
    return P.flicker(X.anim(spark, d)).withColumn("delta", F.round("delta", 6))
