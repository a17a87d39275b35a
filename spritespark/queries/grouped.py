"""Helpers inside one image, files, listings and measures over the projections."""

from pyspark.sql import functions as F

from spritespark.operators import grouped as G
from spritespark.operators import lookups as L
from spritespark.operators import neighbors as N
from spritespark.operators import points as P
from spritespark.operators import structure as S
from spritespark.operators.ranges import long_line
from spritespark.queries.registry import query
from spritespark.sources import files
from spritespark.sources import fixtures as X


_REGION = "ok AS (SELECT p.image_id, p.x, p.y FROM emb_gray p JOIN seeds s ON s.image_id=p.image_id WHERE abs(p.v-s.seed)<=20), hit AS (SELECT image_id, CAST(3 AS BIGINT) AS x, CAST(3 AS BIGINT) AS y FROM seeds UNION SELECT ok.image_id, ok.x, ok.y FROM hit JOIN ok ON ok.image_id=hit.image_id AND abs(ok.x-hit.x)+abs(ok.y-hit.y)=1)"
_SEEDS = "seeds AS (SELECT image_id, v AS seed FROM emb_gray WHERE x=3 AND y=3)"


@query("flood_select", f"WITH RECURSIVE {_SEEDS}, {_REGION} SELECT image_id, x, y FROM hit")
def flood_select(spark, d):
    return G.flood_select(X.emb_gray(spark, d), 3, 3, 20)


@query("flood_fill", "WITH s AS (SELECT image_id, v AS seed FROM emb_gray WHERE x=3 AND y=3) SELECT p.image_id, p.x, p.y, CASE WHEN abs(p.v-s.seed)<=20 THEN 255 ELSE p.v END AS v FROM emb_gray p JOIN s ON s.image_id=p.image_id")
def flood_fill(spark, d):
    """Everywhere: the colour of the seed is replaced in the whole image."""
    return G.flood_fill(X.emb_gray(spark, d).drop("sprite_id"), 3, 3, 20, 255, contiguous=False)


@query("flood_fill_contiguous", f"WITH RECURSIVE {_SEEDS}, {_REGION} SELECT p.image_id, p.sprite_id, p.x, p.y, CASE WHEN hit.x IS NULL THEN p.v ELSE 255 END AS v FROM emb_gray p LEFT JOIN hit ON hit.image_id=p.image_id AND hit.x=p.x AND hit.y=p.y")
def flood_fill_contiguous(spark, d):
    return G.flood_fill(X.emb_gray(spark, d), 3, 3, 20, 255)


@query("connected_bg", "WITH RECURSIVE ok AS (SELECT image_id, x, y FROM emb_gray WHERE v>=110), hit AS (SELECT image_id, x, y FROM ok WHERE x=0 OR y=0 OR x=7 OR y=7 UNION SELECT ok.image_id, ok.x, ok.y FROM hit JOIN ok ON ok.image_id=hit.image_id AND abs(ok.x-hit.x)+abs(ok.y-hit.y)=1) SELECT image_id, x, y FROM hit")
def connected_bg(spark, d):
    return G.connected_background(X.emb_gray(spark, d).filter("v >= 110"), 8, 8)


@query("udf_image_map", "SELECT p.image_id, p.x, p.y, q.v FROM emb_gray p JOIN emb_gray q ON q.image_id=p.image_id AND q.x=p.y AND q.y=7-p.x")
def udf_image_map(spark, d):
    return G.map_images(X.emb_gray(spark, d), lambda g: g[::-1].T)


@query("sheet_layout_wrapped", "WITH RECURSIVE n AS (SELECT sheet, item, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, row_number() OVER (PARTITION BY sheet ORDER BY item) AS k FROM samples), p AS (SELECT sheet, item, k, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, w, h, h AS band FROM n WHERE k=1 UNION ALL SELECT n.sheet, n.item, n.k, CASE WHEN p.x+p.w+n.w>40 THEN 0 ELSE p.x+p.w END, CASE WHEN p.x+p.w+n.w>40 THEN p.y+p.band ELSE p.y END, n.w, n.h, CASE WHEN p.x+p.w+n.w>40 THEN n.h ELSE greatest(p.band, n.h) END FROM p JOIN n ON n.sheet=p.sheet AND n.k=p.k+1) SELECT sheet, item, x, y, w, h FROM p")
def sheet_layout_wrapped(spark, d):
    return G.wrapped_layout(X.samples(spark, d), 40)


@query("palette_octree", "SELECT sprite_id, r>>1 AS kr, g>>1 AS kg, b>>1 AS kb, a>>1 AS ka, count(*) AS n, CAST((sum(r)+count(*)//2)//count(*) AS BIGINT) AS r, CAST((sum(g)+count(*)//2)//count(*) AS BIGINT) AS g, CAST((sum(b)+count(*)//2)//count(*) AS BIGINT) AS b, CAST((sum(a)+count(*)//2)//count(*) AS BIGINT) AS a FROM anim_rgba GROUP BY sprite_id, r>>1, g>>1, b>>1, a>>1")
def palette_octree(spark, d):
    return G.octree_leaves(X.anim_rgba(spark, d))


def _hist(spark, d):
    return X.anim_rgba(spark, d).filter("a > 0").groupBy("sprite_id", "r", "g", "b").agg(F.count("*").alias("n"))


@query("palette_exact_recurrent")
def palette_exact_recurrent(spark, d):
    return G.recurrent_palette(_hist(spark, d))


@query("src_palette_text", "SELECT sprite_id, idx, r, g, b FROM palettes_asof WHERE frame_from=0")
def src_palette_text(spark, d):
    """Palettes written as text and parsed again."""
    text = files.palette_text(X.palettes_asof(spark, d).filter("frame_from = 0"), ["sprite_id"])
    lines = text.select(F.col("sprite_id").alias("file"), F.posexplode(F.split("gpl", "\n")).alias("line_no", "line"))
    return files.parse_gpl(lines).select(F.col("file").alias("sprite_id"), "idx", "r", "g", "b")


@query("sink_palette", "SELECT sprite_id, 'GIMP Palette' || chr(10) || '#' || chr(10) || string_agg(lpad(CAST(r AS VARCHAR),3,' ') || ' ' || lpad(CAST(g AS VARCHAR),3,' ') || ' ' || lpad(CAST(b AS VARCHAR),3,' ') || chr(9) || 'Index ' || idx, chr(10) ORDER BY idx) || chr(10) AS gpl FROM palettes_asof WHERE frame_from=0 GROUP BY sprite_id")
def sink_palette(spark, d):
    return files.palette_text(X.palettes_asof(spark, d).filter("frame_from = 0"), ["sprite_id"])


@query("sink_user_data_json", "SELECT event_id AS id, '{\"data\":\"' || event_type || '\",\"color\":\"#' || lpad(lower(to_hex(user_id%256)),2,'0') || '0000ff\",\"properties\":{\"k\":\"' || user_id || '\"}}' AS json FROM events")
def sink_user_data_json(spark, d):
    e = X.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), (F.col("user_id") % 256 + (255 << 24)).alias("color"), F.create_map(F.lit("k"), F.col("user_id").cast("string")).alias("properties"))
    return files.user_data_json(rows)


@query("list_layer_hierarchy", "SELECT layer_id, level, repeat('  ', CAST(level AS INTEGER)) || name AS line FROM layer_tree")
def list_layer_hierarchy(spark, d):
    return X.layer_tree(spark, d).select("layer_id", "level", F.concat(F.expr("repeat('  ', level)"), "name").alias("line"))


@query("list_tags", "SELECT sprite_id, string_agg(tag_id || ':' || from_frame || '-' || to_frame, ',' ORDER BY from_frame, tag_id) AS tags FROM tags_tbl GROUP BY sprite_id")
def list_tags(spark, d):
    one = F.concat_ws("", "tag_id", F.lit(":"), "from_frame", F.lit("-"), "to_frame")
    return X.tags_tbl(spark, d).groupBy("sprite_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_frame", "tag_id", one.alias("s")))), lambda x: x["s"]), ",").alias("tags"))


@query("split_keys", "SELECT f.sprite_id, f.frame, t.tag_id, f.frame-t.from_frame AS tag_frame FROM frames_tbl f JOIN tags_tbl t ON t.sprite_id=f.sprite_id AND f.frame BETWEEN t.from_frame AND t.to_frame")
def split_keys(spark, d):
    hit = X.frames_tbl(spark, d).join(X.tags_tbl(spark, d), "sprite_id").filter("frame BETWEEN from_frame AND to_frame")
    return hit.select("sprite_id", "frame", "tag_id", (F.col("frame") - F.col("from_frame")).alias("tag_frame"))


@query("convert_mode", "SELECT image_id, x, y, CASE WHEN idx=32 THEN 0 ELSE ((idx*37)%256*2126+(idx*91)%256*7152+(idx*151)%256*722)//10000 END AS v, CASE WHEN idx=32 THEN 0 ELSE 255 END AS a FROM doc_pixels")
def convert_mode(spark, d):
    """Indexed to RGB by the palette, then to gray; the mask index is transparent black."""
    return P.to_gray(L.palette_lookup(X.doc_pixels(spark, d), X.pal256(spark), mask_index=32)).select("image_id", "x", "y", "v", "a")


@query("mask_extract", "WITH m AS (SELECT image_id, x, y, r, g, b, a FROM emb_rgba WHERE g>90), b AS (SELECT image_id, min(x) AS x0, min(y) AS y0 FROM m GROUP BY image_id) SELECT m.image_id, m.x-x0 AS x, m.y-y0 AS y, r, g, m.b, a FROM m JOIN b ON b.image_id=m.image_id")
def mask_extract(spark, d):
    p = X.emb_rgba(spark, d)
    inside = p.join(p.filter("g > 90").select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")
    at = P.bounds(inside, ("image_id",)).select("image_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    return inside.join(at, "image_id").select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), *"rgba")


for _name, _new in (("selection_fill", 200), ("selection_clear", 0)):
    query(_name, f"SELECT image_id, x, y, CASE WHEN v>=120 THEN {_new} ELSE v END AS v FROM emb_gray")(lambda spark, d, new=_new: P.on_channels(X.emb_gray(spark, d).drop("sprite_id"), lambda c: F.lit(new), ("v",), X.emb_gray(spark, d).filter("v >= 120")))


@query("fidelity_score", "SELECT p.image_id, round(avg(CASE WHEN abs(p.v-q.v)<=8 THEN 1.0 ELSE 0.0 END),6) AS fidelity FROM emb_gray p JOIN emb_gray q ON q.image_id=p.image_id AND q.x=7-p.x AND q.y=p.y GROUP BY p.image_id")
def fidelity_score(spark, d):
    p = X.emb_gray(spark, d)
    other = N.flip(p, 8, 8).select("image_id", "x", "y", F.col("v").alias("w"))
    return p.join(other, ["image_id", "x", "y"]).groupBy("image_id").agg(F.round(F.avg((F.abs(F.col("v") - F.col("w")) <= 8).cast("double")), 6).alias("fidelity"))


@query("bg_quality", "SELECT image_id, round(count(*) FILTER (WHERE a=0 AND v<120)/nullif(count(*) FILTER (WHERE v<120),0),6) AS recall, round(count(*) FILTER (WHERE a=0 AND v>=120)/nullif(count(*) FILTER (WHERE v>=120),0),6) AS damage FROM (SELECT p.image_id, p.v, q.a FROM emb_gray p JOIN emb_rgba q ON q.image_id=p.image_id AND q.x=p.x AND q.y=p.y) GROUP BY image_id")
def bg_quality(spark, d):
    both = X.emb_gray(spark, d).join(X.emb_rgba(spark, d).select("image_id", "x", "y", "a"), ["image_id", "x", "y"])
    share = lambda c: F.round(F.count_if((F.col("a") == 0) & c) / F.nullif(F.count_if(c), F.lit(0)), 6)
    return both.groupBy("image_id").agg(share(F.col("v") < 120).alias("recall"), share(F.col("v") >= 120).alias("damage"))


@query("border_model_tile", "WITH s AS (SELECT unnest([1,2,4,8]) AS p), c AS (SELECT image_id, p, x%p AS px, y%p AS py, v//32 AS v, count(*) AS n FROM emb_gray, s GROUP BY ALL), m AS (SELECT image_id, p, px, py, max(n) AS n FROM c GROUP BY ALL) SELECT image_id, p AS pitch, CAST(sum(n) AS BIGINT) AS matched FROM m GROUP BY image_id, p")
def border_model_tile(spark, d):
    """For each square pitch: how many pixels have the modal value of their phase."""
    p = X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 32).alias("v"), F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("pitch"))
    counts = p.groupBy("image_id", "pitch", (F.col("x") % F.col("pitch")).alias("px"), (F.col("y") % F.col("pitch")).alias("py"), "v").agg(F.count("*").alias("n"))
    return counts.groupBy("image_id", "pitch", "px", "py").agg(F.max("n").alias("n")).groupBy("image_id", "pitch").agg(F.sum("n").alias("matched"))


@query("tile_match", "WITH b AS (SELECT image_id, x//2 AS u, y//2 AS w, string_agg(CASE WHEN v>=128 THEN '1' ELSE '0' END, '' ORDER BY y, x) AS t FROM emb_gray GROUP BY image_id, x//2, y//2), f AS (SELECT *, substr(t,2,1)||substr(t,1,1)||substr(t,4,1)||substr(t,3,1) AS fx, substr(t,3,2)||substr(t,1,2) AS fy, reverse(t) AS fxy FROM b) SELECT image_id, u, w, least(t, fx, fy, fxy) AS canonical, CASE least(t, fx, fy, fxy) WHEN t THEN 0 WHEN fx THEN 1 WHEN fy THEN 2 ELSE 3 END AS flip FROM f")
def tile_match(spark, d):
    """Tiles that are equal up to a flip share the least of their four forms; the first flip that gives it is named."""
    bits = X.emb_gray(spark, d).withColumn("v", F.when(F.col("v") >= 128, 1).otherwise(0))
    t = F.split("tile", ",")
    form = lambda *o: F.concat(*(t[i] for i in o))
    forms = F.array(form(0, 1, 2, 3), form(1, 0, 3, 2), form(2, 3, 0, 1), form(3, 2, 1, 0))
    return S.cut_tiles(bits, 2, 2).select("image_id", "u", "w", F.array_min(forms).alias("canonical"), (F.array_position(forms, F.array_min(forms)) - 1).alias("flip"))


@query("best_trim_color", "WITH c AS (SELECT image_id, x, y, CASE WHEN v<70 THEN 0 WHEN v<150 THEN 200+256*200+65536*200+255*16777216::BIGINT ELSE 90+256*90+65536*90+255*16777216::BIGINT END AS c FROM emb_gray), e AS (SELECT image_id, max(c) FILTER (WHERE x=0 AND y=0) AS c1, max(c) FILTER (WHERE x=7 AND y=7) AS c2, bool_or(c=0) FILTER (WHERE y IN (0,7)) AS z1, bool_or(c=0) FILTER (WHERE x IN (0,7)) AS z2, count(DISTINCT c) FILTER (WHERE y=0)=1 AS t, count(DISTINCT c) FILTER (WHERE y=7)=1 AS b, count(DISTINCT c) FILTER (WHERE x=0)=1 AS l, count(DISTINCT c) FILTER (WHERE x=7)=1 AS r FROM c GROUP BY image_id) SELECT image_id, CAST(CASE WHEN z1 THEN 0 WHEN t AND b AND c1<>c2 THEN NULL WHEN z2 THEN 0 WHEN l AND r AND c1<>c2 THEN NULL WHEN (b AND NOT t) OR (r AND NOT l) THEN c2 ELSE c1 END AS BIGINT) AS color FROM e")
def best_trim_color(spark, d):
    shade = F.when(F.col("v") < 150, 200).otherwise(90)
    p = X.emb_gray(spark, d).select("image_id", "x", "y", *(shade.alias(c) for c in "rgb"), F.when(F.col("v") < 70, 0).otherwise(255).alias("a"))
    return P.trim_color(p, 8, 8)


@query("palette_gradient", "SELECT sprite_id, i AS idx, CAST(floor((sprite_id%100) + ((200-(sprite_id%100))*i)/15.0 + 1e-9) AS BIGINT) AS r FROM turns, (SELECT unnest(range(16)) AS i)")
def palette_gradient(spark, d):
    rows = X.turns(spark, d).select((F.col("sprite_id")).alias("sprite_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("idx"))
    first = F.col("sprite_id") % 100
    return rows.select("sprite_id", "idx", F.floor(first + (200 - first) * F.col("idx") / F.lit(15.0) + 1e-9).alias("r"))


@query("best_trim_refcolor", "WITH e AS (SELECT image_id, bool_and(a=0) FILTER (WHERE y=0) AS t, bool_and(a=0) FILTER (WHERE y=7) AS b, bool_and(a=0) FILTER (WHERE x=0) AS l, bool_and(a=0) FILTER (WHERE x=7) AS r FROM emb_rgba GROUP BY image_id) SELECT image_id, t OR b OR l OR r AS transparent FROM e")
def best_trim_refcolor(spark, d):
    """Whether a whole side is transparent: the reference colour is transparent then."""
    sides = {"t": "y = 0", "b": "y = 7", "l": "x = 0", "r": "x = 7"}
    e = X.emb_rgba(spark, d).groupBy("image_id").agg(*(F.bool_and(F.when(F.expr(w), F.col("a") == 0)).alias(k) for k, w in sides.items()))
    return e.select("image_id", (F.col("t") | F.col("b") | F.col("l") | F.col("r")).alias("transparent"))


@query("render_sheet", "SELECT p.sprite_id AS sheet, p.x + s.off AS x, p.y, p.v FROM emb_gray p JOIN (SELECT sprite_id, image_id, 9*(row_number() OVER (PARTITION BY sprite_id ORDER BY image_id)-1) AS off FROM (SELECT DISTINCT sprite_id, image_id FROM emb_gray)) s ON s.image_id=p.image_id")
def render_sheet(spark, d):
    p = X.emb_gray(spark, d)
    items = X.table(spark, d, "embeddings").select(F.col("label").alias("sheet"), F.col("vec_id").alias("item"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    slots = long_line(items, padding=1).select(F.col("item").alias("image_id"), "sheet", F.col("x").alias("sx"), F.col("y").alias("sy"))
    return p.join(slots, "image_id").select("sheet", (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"), "v")


@query("chroma_key_detect", "WITH e AS (SELECT image_id, r//24*24 AS r, g//24*24 AS g, b//24*24 AS b, count(*) AS n FROM emb_rgba WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY image_id, r//24, g//24, b//24), t AS (SELECT *, n/sum(n) OVER (PARTITION BY image_id) AS share, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS k FROM e) SELECT image_id, r, g, b, share>0.3 AND greatest(r,g,b)-least(r,g,b)>60 AS is_key FROM t WHERE k=1")
def chroma_key_detect(spark, d):
    coarse = X.emb_rgba(spark, d).select("image_id", "x", "y", *((F.floor(F.col(c) / 24) * 24).cast("int").alias(c) for c in "rgb"))
    top = N.border_shares(coarse, 8, 8, channels=("r", "g", "b"), least=0.0, most=1)
    return top.select("image_id", "r", "g", "b", ((F.col("share") > 0.3) & (F.greatest("r", "g", "b") - F.least("r", "g", "b") > 60)).alias("is_key"))
