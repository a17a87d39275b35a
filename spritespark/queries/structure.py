"""Joins, windows, sheets, layers, selections and tiles over the projections."""

from pyspark.sql import functions as F

from spritespark.functions.color import cielab, oklab
from spritespark.operators import lookups as L
from spritespark.operators import sheets as H
from spritespark.operators import structure as S
from spritespark.operators.joins import shuffled
from spritespark.operators.ranges import numbered
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X


@query("palette_lookup", "SELECT image_id, x, y, p.idx, CASE WHEN p.idx=32 THEN 0 ELSE q.r END AS r, CASE WHEN p.idx=32 THEN 0 ELSE q.g END AS g, CASE WHEN p.idx=32 THEN 0 ELSE q.b END AS b, CASE WHEN p.idx=32 THEN 0 ELSE q.a END AS a FROM doc_pixels p JOIN pal256 q ON p.idx = q.idx")
def palette_lookup(spark, d):
    return L.palette_lookup(X.doc_pixels(spark, d), X.pal256(spark), mask_index=32)


@query("palette_asof", "SELECT p.sprite_id, p.frame, p.x, p.y, q.frame_from, q.r, q.g, q.b, q.a FROM anim p JOIN palettes_asof q ON q.sprite_id=p.sprite_id AND q.idx=p.idx AND q.frame_from = CASE WHEN p.frame >= 3 THEN 3 ELSE 0 END")
def palette_asof(spark, d):
    keyed = X.palettes_asof(spark, d)
    p = X.anim(spark, d)
    spans = L.as_of(p.select("sprite_id", "frame").distinct(), keyed.select("sprite_id", "frame_from").distinct(), ["sprite_id"], kind="inner")
    return shuffled(shuffled(p).join(spans, ["sprite_id", "frame"])).join(keyed, ["sprite_id", "frame_from", "idx"]).select("sprite_id", "frame", "x", "y", "frame_from", "r", "g", "b", "a")


@query("slice_asof", "SELECT f.sprite_id, f.frame, k.frame_from, k.x, k.y, k.w, k.h FROM frames_tbl f LEFT JOIN slice_keys k ON k.sprite_id=f.sprite_id AND k.frame_from = CASE WHEN f.frame>=4 THEN 4 WHEN f.frame>=1 THEN 1 END")
def slice_asof(spark, d):
    return L.as_of(X.frames_tbl(spark, d).select("sprite_id", "frame"), X.slice_keys(spark, d), ["sprite_id"])


_TAG = "SELECT sprite_id, frame, tag_id FROM (SELECT f.sprite_id, f.frame, t.tag_id, row_number() OVER (PARTITION BY f.sprite_id, f.frame ORDER BY {s}(t.to_frame-t.from_frame), t.from_frame, t.tag_id) AS k FROM frames_tbl f JOIN tags_tbl t ON t.sprite_id=f.sprite_id AND f.frame BETWEEN t.from_frame AND t.to_frame) WHERE k=1"


@query("tag_inner", _TAG.format(s=""))
def tag_inner(spark, d):
    return L.innermost_tags(X.frames_tbl(spark, d), X.tags_tbl(spark, d), ["sprite_id"])


@query("tag_outer", _TAG.format(s="-"))
def tag_outer(spark, d):
    return L.innermost_tags(X.frames_tbl(spark, d), X.tags_tbl(spark, d), ["sprite_id"], outer=True)


@query("linked_cels", "WITH c AS (SELECT conv_id AS sprite_id, turn AS frame, length(text)%7 AS data_id FROM conversations) SELECT c.sprite_id, c.frame, c.data_id, o.origin, o.links FROM c JOIN (SELECT sprite_id, data_id, min(frame) AS origin, count(*) AS links FROM c GROUP BY ALL) o ON o.sprite_id=c.sprite_id AND o.data_id=c.data_id")
def linked_cels(spark, d):
    c = X.table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.col("turn").alias("frame"), (F.length("text") % 7).alias("data_id"))
    return L.linked_cels(c, ["sprite_id"])


@query("pick_cels", "SELECT e.event_id AS point_id, max(p.frame) AS z FROM events e JOIN anim_rgba p ON p.sprite_id=e.user_id%100 AND p.x=e.event_id%32 AND p.y=(e.event_id//32)%16 WHERE p.a>0 GROUP BY e.event_id")
def pick_cels(spark, d):
    e = F.col("event_id")
    points = X.table(spark, d, "events").select(e.alias("point_id"), (F.col("user_id") % 100).alias("sprite_id"), (e % 32).alias("x"), (F.floor(e / 32) % 16).alias("y"))
    return L.pick_cels(points, X.anim_rgba(spark, d).withColumn("z", F.col("frame")))


def _small(spark):
    return X.pal256(spark).select("idx", *(F.col(c).alias(f"p{c}") for c in "rgba"))


_DIST = "900*((c.r>>3)-(q.r>>3))*((c.r>>3)-(q.r>>3))+3481*((c.g>>3)-(q.g>>3))*((c.g>>3)-(q.g>>3))+121*((c.b>>3)-(q.b>>3))*((c.b>>3)-(q.b>>3))+64*((c.a>>3)-(q.a>>3))*((c.a>>3)-(q.a>>3))"
_NEAR = "WITH c AS (SELECT DISTINCT r, g, b, a FROM emb_rgba), m AS (SELECT c.r, c.g, c.b, c.a, q.idx, {d} AS d FROM c JOIN pal256 q ON true) SELECT r, g, b, a, idx, {out} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b, a ORDER BY d, idx) AS k FROM m) WHERE k=1"


@query("nearest_palette", _NEAR.format(d=_DIST, out="CAST(d AS BIGINT)"))
def nearest_palette(spark, d):
    return L.nearest_palette(X.emb_rgba(spark, d), _small(spark), L.weighted_distance())


@query("nearest_palette_space", _NEAR.format(d="(c.r-q.r)*(c.r-q.r)+(c.g-q.g)*(c.g-q.g)+(c.b-q.b)*(c.b-q.b)", out="CAST(d AS BIGINT)"))
def nearest_palette_space(spark, d):
    square = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "rgb"), F.lit(0))
    return L.nearest_palette(X.emb_rgba(spark, d), _small(spark), square)


_LINEAR = ", ".join(f"CASE WHEN {c}/255.0::DOUBLE<=0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055,2.4) END AS {n}" for c, n in zip("rgb", ("x1", "x2", "x3"), strict=True))
_COLORS = f"u AS (SELECT r, g, b FROM emb_rgba UNION SELECT r, g, b FROM pal256), lin AS (SELECT r, g, b, {_LINEAR} FROM u)"
_CIE = "xyz AS (SELECT r, g, b, 100*(0.4124::DOUBLE*x1+0.3576::DOUBLE*x2+0.1805::DOUBLE*x3)/95.047::DOUBLE AS x, 0.2126::DOUBLE*x1+0.7152::DOUBLE*x2+0.0722::DOUBLE*x3 AS y, 100*(0.0193::DOUBLE*x1+0.1192::DOUBLE*x2+0.9505::DOUBLE*x3)/108.883::DOUBLE AS z FROM lin), cut AS (SELECT r, g, b, " + ", ".join(f"CASE WHEN {c}>0.008856 THEN cbrt({c}) ELSE 7.787::DOUBLE*{c}+16/116.0::DOUBLE END AS {c}" for c in "xyz") + " FROM xyz), lab AS (SELECT r, g, b, 116*y-16 AS l1, 500*(x-y) AS l2, 200*(y-z) AS l3 FROM cut)"
_OK = "lms AS (SELECT r, g, b, cbrt(0.4122214708::DOUBLE*x1+0.5363325363::DOUBLE*x2+0.0514459929::DOUBLE*x3) AS l, cbrt(0.2119034982::DOUBLE*x1+0.6806995451::DOUBLE*x2+0.1073969566::DOUBLE*x3) AS m, cbrt(0.0883024619::DOUBLE*x1+0.2817188376::DOUBLE*x2+0.6299787005::DOUBLE*x3) AS s FROM lin), lab AS (SELECT r, g, b, 0.2104542553::DOUBLE*l+0.7936177850::DOUBLE*m-0.0040720468::DOUBLE*s AS l1, 1.9779984951::DOUBLE*l-2.4285922050::DOUBLE*m+0.4505937099::DOUBLE*s AS l2, 0.0259040371::DOUBLE*l+0.7827717662::DOUBLE*m-0.8086757660::DOUBLE*s AS l3 FROM lms)"
_LAB_NEAR = "c AS (SELECT d.a, lab.* FROM (SELECT DISTINCT r, g, b, a FROM emb_rgba) d JOIN lab USING (r, g, b)), q AS (SELECT p.idx, lab.* FROM pal256 p JOIN lab USING (r, g, b)), m AS (SELECT c.r, c.g, c.b, c.a, q.idx, round((c.l1-q.l1)*(c.l1-q.l1)+(c.l2-q.l2)*(c.l2-q.l2)+(c.l3-q.l3)*(c.l3-q.l3), {digits}) AS d FROM c, q), k AS (SELECT *, row_number() OVER (PARTITION BY r, g, b, a ORDER BY d, idx) AS k FROM m) SELECT r, g, b, a, idx, {out} AS distance FROM k WHERE k=1"


@query("nearest_palette_lab", f"WITH {_COLORS}, {_CIE}, {_LAB_NEAR.format(digits=6, out='round(d, 4)')}")
def nearest_palette_lab(spark, d):
    lab = sum(((a - b) * (a - b) for a, b in zip(cielab(), cielab("pr", "pg", "pb"), strict=True)), F.lit(0.0))
    return L.nearest_palette(X.emb_rgba(spark, d), _small(spark), F.round(lab, 6)).withColumn("distance", F.round("distance", 4))


@query("snap_oklab", f"WITH {_COLORS}, {_OK}, {_LAB_NEAR.format(digits=9, out='round(sqrt(d), 6)')}")
def snap_oklab(spark, d):
    lab = sum(((a - b) * (a - b) for a, b in zip(oklab(), oklab("pr", "pg", "pb"), strict=True)), F.lit(0.0))
    return L.nearest_palette(X.emb_rgba(spark, d), _small(spark), F.round(lab, 9)).withColumn("distance", F.round(F.sqrt("distance"), 6))


@query("unused_palette", "SELECT t.sprite_id, p.idx FROM turns t, pal256 p WHERE NOT EXISTS (SELECT 1 FROM anim a WHERE a.sprite_id=t.sprite_id AND a.idx=p.idx)")
def unused_palette(spark, d):
    entries = X.turns(spark, d).select("sprite_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    return L.used_entries(entries, X.anim(spark, d), ["sprite_id", "idx"], used=False)


@query("used_palette", "SELECT DISTINCT sprite_id, idx FROM anim WHERE idx BETWEEN 0 AND 255")
def used_palette(spark, d):
    entries = X.turns(spark, d).select("sprite_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    return L.used_entries(entries, X.anim(spark, d), ["sprite_id", "idx"])


@query("palette_stats", "SELECT p.sprite_id, count(*) FILTER (WHERE p.r<>q.r OR p.g<>q.g OR p.b<>q.b OR p.a<>q.a) AS n, min(p.idx) FILTER (WHERE p.r<>q.r OR p.g<>q.g OR p.b<>q.b OR p.a<>q.a) AS first, max(p.idx) FILTER (WHERE p.r<>q.r OR p.g<>q.g OR p.b<>q.b OR p.a<>q.a) AS last, bool_or(p.a<255) AS has_alpha, bool_or(p.a>0 AND p.a<255) AS has_semi_alpha, bool_and(p.r=0 AND p.g=0 AND p.b=0) AS all_black FROM palettes_asof p JOIN palettes_asof q ON q.sprite_id=p.sprite_id AND q.idx=p.idx WHERE p.frame_from=0 AND q.frame_from=3 GROUP BY p.sprite_id")
def palette_stats(spark, d):
    p = X.palettes_asof(spark, d)
    return L.palette_differences(p.filter("frame_from = 0"), p.filter("frame_from = 3"), ["sprite_id"])


@query("palette_merge", "WITH f AS (SELECT sprite_id, r, g, b, a, min(frame_from*1000+idx) AS o FROM palettes_asof GROUP BY ALL) SELECT sprite_id, r, g, b, a, row_number() OVER (PARTITION BY sprite_id ORDER BY o)-1 AS idx FROM f")
def palette_merge(spark, d):
    return L.merge_palettes(X.palettes_asof(spark, d), ["sprite_id"], ["frame_from", "idx"])


@query("sprite_diff", "SELECT conv_id AS sprite_id, turn AS frame, CASE WHEN turn%2=1 AND length(text)%2=0 THEN 'removed' WHEN length(text)%3=0 THEN 'changed' END AS change FROM conversations WHERE (turn%2=1 AND length(text)%2=0) OR length(text)%3=0")
def sprite_diff(spark, d):
    one = X.table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.col("turn").alias("frame"), F.length("text").alias("n"))
    two = one.filter("NOT (frame % 2 = 1 AND n % 2 = 0)").withColumn("n", F.when(F.col("n") % 3 == 0, -1).otherwise(F.col("n")))
    return L.table_diff(one, two, ["sprite_id", "frame"], ["n"])


@query("remap", "SELECT idx AS src, sprite_id, (idx*5%256 + sprite_id)%256 AS dst FROM (SELECT DISTINCT sprite_id, idx FROM anim)")
def remap(spark, d):
    used = X.anim(spark, d).select("sprite_id", F.col("idx").alias("src")).distinct()
    then = X.turns(spark, d).select("sprite_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("src")).withColumn("dst", (F.col("src") + F.col("sprite_id")) % 256)
    return L.compose_remaps(used.withColumn("dst", F.col("src") * 5 % 256), then, ("sprite_id",))


@query("remap_invert", "SELECT sprite_id, idx*5%64 AS src, min(idx) AS dst FROM anim GROUP BY sprite_id, idx*5%64")
def remap_invert(spark, d):
    used = X.anim(spark, d).select("sprite_id", F.col("idx").alias("src")).distinct()
    return L.invert_remap(used.withColumn("dst", F.col("src") * 5 % 64), ("sprite_id",))


# time


@query("animation_duration", "SELECT sprite_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM frames_tbl GROUP BY sprite_id")
def animation_duration(spark, d):
    return X.frames_tbl(spark, d).groupBy("sprite_id").agg(F.sum("duration_ms").alias("total_ms"))


@query("frame_start_time", "SELECT sprite_id, frame, duration_ms, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY sprite_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM frames_tbl")
def frame_start_time(spark, d):
    return S.frame_times(X.frames_tbl(spark, d))


@query("frame_ranges", "WITH s AS (SELECT sprite_id, frame FROM frames_tbl WHERE duration_ms%3<>0), i AS (SELECT *, frame-row_number() OVER (PARTITION BY sprite_id ORDER BY frame) AS g FROM s) SELECT sprite_id, min(frame) AS from_frame, max(frame) AS to_frame FROM i GROUP BY sprite_id, g")
def frame_ranges(spark, d):
    return S.frame_ranges(X.frames_tbl(spark, d).filter("duration_ms % 3 <> 0").select("sprite_id", "frame"))


@query("frame_select", "SELECT f.sprite_id, f.frame, f.duration_ms FROM frames_tbl f JOIN tags_tbl t ON t.sprite_id=f.sprite_id AND t.tag_id=2 AND f.frame BETWEEN t.from_frame AND least(t.to_frame, t.from_frame+1)")
def frame_select(spark, d):
    return S.select_frames(X.frames_tbl(spark, d), X.tags_tbl(spark, d), 2, 0, 1)


@query("reverse_frames", "SELECT f.sprite_id, t.n-1-f.frame AS frame, f.duration_ms FROM frames_tbl f JOIN turns t ON t.sprite_id=f.sprite_id")
def reverse_frames(spark, d):
    return X.frames_tbl(spark, d).join(X.turns(spark, d), "sprite_id").select("sprite_id", (F.col("n") - 1 - F.col("frame")).alias("frame"), "duration_ms")


@query("playback_expand", "WITH t AS (SELECT *, to_frame-from_frame+1 AS len, CASE WHEN rep=0 AND dir>=2 THEN 2 ELSE greatest(1, rep) END AS k FROM tags_tbl), p AS (SELECT *, unnest(range(k)) AS pass FROM t), s AS (SELECT *, unnest(range(len)) AS i FROM p), f AS (SELECT sprite_id, tag_id, pass, i, CASE WHEN dir=0 OR (dir=2 AND pass%2=0) OR (dir=3 AND pass%2=1) THEN from_frame+i ELSE to_frame-i END AS frame FROM s WHERE dir<2 OR pass=0 OR i>0) SELECT sprite_id, tag_id, row_number() OVER (PARTITION BY sprite_id, tag_id ORDER BY pass, i)-1 AS step, frame FROM f")
def playback_expand(spark, d):
    return S.play(X.tags_tbl(spark, d))


# sheets


@query("sample_numbering", "SELECT sheet, item, row_number() OVER (PARTITION BY sheet ORDER BY item)-1 AS number FROM samples")
def sample_numbering(spark, d):
    return H.number_samples(X.samples(spark, d), ["sheet"], ["item"]).select("sheet", "item", "number")


@query("sheet_layout_h", "SELECT sheet, item, CAST(2+coalesce(sum(w+3) OVER (PARTITION BY sheet ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS x, 2 AS y FROM samples")
def sheet_layout_h(spark, d):
    return H.layout_line(X.samples(spark, d), border=2, padding=1, inner=1).select("sheet", "item", "x", "y")


@query("sheet_layout_v", "SELECT sheet, item, 2 AS x, CAST(2+coalesce(sum(h+3) OVER (PARTITION BY sheet ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS y FROM samples")
def sheet_layout_v(spark, d):
    return H.layout_line(X.samples(spark, d), vertical=True, border=2, padding=1, extrude=1).select("sheet", "item", "x", "y")


_ROWS = "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY sheet ORDER BY item)-1)//2 AS band FROM samples), m AS (SELECT sheet, band, max({c}) AS most FROM n GROUP BY ALL), o AS (SELECT sheet, band, 1+coalesce(sum(most+1) OVER (PARTITION BY sheet ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM m), l AS (SELECT n.*, 1+coalesce(sum({a}+1) OVER (PARTITION BY n.sheet, n.band ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS along FROM n) SELECT l.sheet, l.item, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y FROM l JOIN o ON o.sheet=l.sheet AND o.band=l.band"


@query("sheet_layout_rows", _ROWS.format(a="w", c="h", x="along", y="off"))
def sheet_layout_rows(spark, d):
    return H.layout_rows(X.samples(spark, d), 2, border=1, padding=1).select("sheet", "item", "x", "y")


@query("sheet_layout_cols", _ROWS.format(a="h", c="w", x="off", y="along"))
def sheet_layout_cols(spark, d):
    return H.layout_rows(X.samples(spark, d), 2, border=1, padding=1, columns=True).select("sheet", "item", "x", "y")


@query("sheet_size", "WITH t AS (SELECT sheet, sum(w) AS width, max(h) AS height FROM samples GROUP BY sheet) SELECT sheet, CAST(pow(2, ceil(log2(width))) AS BIGINT) AS width, CAST(pow(2, ceil(log2(height))) AS BIGINT) AS height FROM t")
def sheet_size(spark, d):
    return H.sheet_size(H.layout_line(X.samples(spark, d)), power_of_two=True)


@query("image_hash_dedupe", "WITH h AS (SELECT image_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS s FROM (SELECT doc_id AS image_id, 0 AS x, 0 AS y, text AS v FROM documents WHERE length(text)>0) GROUP BY image_id) SELECT image_id, min(image_id) OVER (PARTITION BY s) AS original FROM h")
def image_hash_dedupe(spark, d):
    """Images of equal content: those of equal texts, as the palette gives each character another colour."""
    hashes = H.image_hashes(X.with_colors(X.doc_pixels(spark, d)), ["image_id"])
    return H.merge_duplicates(hashes, "image_id").select("image_id", "original")


@query("sheet_import", "SELECT image_id, (y//4)*2+x//4 AS frame, x%4 AS x, y%4 AS y, v FROM emb_gray")
def sheet_import(spark, d):
    return H.import_sheet(X.emb_gray(spark, d), 8, 8, 4, 4).select("image_id", "frame", "x", "y", "v")


@query("merge_frames_to_sprite", "SELECT sprite_id, image_id, row_number() OVER (PARTITION BY sprite_id ORDER BY image_id)-1 AS frame FROM (SELECT DISTINCT sprite_id, image_id FROM emb_gray)")
def merge_frames_to_sprite(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("label").alias("sprite_id"), F.col("vec_id").alias("image_id"))
    return numbered(rows, ["sprite_id"], ["image_id"]).withColumnRenamed("number", "frame")


@query("sink_sheet_json", "SELECT sheet, item, '{\"filename\":\"s' || sheet || '-' || item || '\",\"frame\":{\"x\":' || (sum(w) OVER (PARTITION BY sheet ORDER BY item)-w) || ',\"y\":0,\"w\":' || w || ',\"h\":' || h || '},\"rotated\":false,\"trimmed\":false,\"spriteSourceSize\":{\"x\":0,\"y\":0,\"w\":' || w || ',\"h\":' || h || '},\"sourceSize\":{\"w\":' || w || ',\"h\":' || h || '},\"duration\":100}' AS json FROM samples")
def sink_sheet_json(spark, d):
    s = H.layout_line(X.samples(spark, d)).withColumns({"name": F.format_string("s%d-%d", "sheet", "item"), "duration_ms": F.lit(100)})
    return s.select("sheet", "item", "name").join(H.frame_json(s), "name").drop("name")


@query("src_sheet_json", "SELECT 's' || sheet || '-' || item AS name, CAST(sum(w) OVER (PARTITION BY sheet ORDER BY item)-w AS BIGINT) AS x, 0 AS y, w, h, 100 AS duration_ms FROM samples")
def src_sheet_json(spark, d):
    s = H.layout_line(X.samples(spark, d)).withColumns({"name": F.format_string("s%d-%d", "sheet", "item"), "duration_ms": F.lit(100)})
    return H.read_frame_json(H.frame_json(s))


@query("src_frame_sequence", "SELECT p_type || '_' || p_brand AS left_part, '.png' AS right_part, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT p_type, replace(p_brand, '#', '_') || '_' AS p_brand, p_partkey FROM part) GROUP BY ALL")
def src_frame_sequence(spark, d):
    names = X.table(spark, d, "part").select(F.concat("p_type", F.lit("_"), F.regexp_replace("p_brand", "#", "_"), F.lit("_"), F.format_string("%06d", "p_partkey"), F.lit(".png")).alias("name"))
    left, number, right, _ = H.split_name()
    return names.select(left, number, right).groupBy(F.col("left").alias("left_part"), F.col("right").alias("right_part")).agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last"))


@query("filename_format", "SELECT sheet, item, 'sheet' || sheet || '-' || lpad(CAST(item+1 AS VARCHAR), 3, '0') || '.{none}' AS name FROM samples")
def filename_format(spark, d):
    return X.samples(spark, d).select("sheet", "item", H.format_name("sheet{title}-{frame001}.{none}", {"title": F.col("sheet"), "frame": F.col("item")}).alias("name"))


@query("json_escape", "SELECT event_id, replace(replace(props, '\\', '\\\\'), '\"', '\\\"') AS escaped FROM events")
def json_escape(spark, d):
    return X.table(spark, d, "events").select("event_id", F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')).alias("escaped"))


@query("grid_math", "SELECT image_id, x, y, CAST(floor((x-3)/5.0) AS BIGINT) AS u, CAST(floor((y-3)/3.0) AS BIGINT) AS v, CAST(floor((x-3)/5.0)*5+3 AS BIGINT) AS snap FROM emb_gray")
def grid_math(spark, d):
    u, v = F.floor((F.col("x") - 3) / 5), F.floor((F.col("y") - 3) / 3)
    return X.emb_gray(spark, d).select("image_id", "x", "y", u.alias("u"), v.alias("v"), (u * 5 + 3).alias("snap"))


# layers


@query("layer_path", "SELECT layer_id, level, name, path FROM layer_tree")
def layer_path(spark, d):
    return S.layer_paths(X.layer_tree(spark, d)).select("layer_id", "level", "name", "path")


@query("visible_hierarchy", "WITH a AS (SELECT layer_id, visible FROM layer_tree WHERE level=0), b AS (SELECT t.layer_id, t.visible AND a.visible AS visible FROM layer_tree t JOIN a ON t.parent_id=a.layer_id), c AS (SELECT t.layer_id, t.visible AND b.visible AS visible FROM layer_tree t JOIN b ON t.parent_id=b.layer_id) SELECT layer_id, visible AS shown FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def visible_hierarchy(spark, d):
    return S.layer_paths(X.layer_tree(spark, d)).select("layer_id", "shown")


@query("layer_filter", "SELECT layer_id, path FROM layer_tree WHERE (path LIKE 'ASIA/%' OR path LIKE '%/NATION\\_1/%' ESCAPE '\\') AND path NOT LIKE '%/NATION\\_2/%' ESCAPE '\\' AND path NOT LIKE '%/NATION\\_2' ESCAPE '\\'")
def layer_filter(spark, d):
    return S.filter_layers(S.layer_paths(X.layer_tree(spark, d)), ["ASIA/*", "*/NATION_1/*"], ["*/NATION_2/*"]).select("layer_id", "path")


@query("render_order", "SELECT conv_id AS sprite_id, turn//3 AS frame, turn%3 AS layer, row_number() OVER (PARTITION BY conv_id, turn//3 ORDER BY turn%3+((conv_id+turn)%3-1), (conv_id+turn)%3-1, turn%3)-1 AS place FROM conversations")
def render_order(spark, d):
    c = X.table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.floor(F.col("turn") / 3).alias("frame"), (F.col("turn") % 3).alias("layer"), ((F.col("conv_id") + F.col("turn")) % 3 - 1).alias("z"))
    return S.render_order(c, ["sprite_id", "frame"]).drop("z")


@query("sort_palette", "SELECT sprite_id, idx, row_number() OVER (PARTITION BY sprite_id ORDER BY CASE WHEN a=0 THEN 0 ELSE 1 END, (r*2126+g*7152+b*722)//10000, idx)-1 AS place FROM palettes_asof WHERE frame_from=0")
def sort_palette(spark, d):
    return S.sort_palette(X.palettes_asof(spark, d).filter("frame_from = 0"), "luma", keys=["sprite_id"]).select("sprite_id", "idx", "place")


# selections


def _masks(spark, d):
    p = X.emb_gray(spark, d)
    return p.filter("v % 3 = 0").select("image_id", "x", "y"), p.filter("v % 2 = 0").select("image_id", "x", "y")


for _name, _op, _where in (("mask_add", S.mask_add, "v%3=0 OR v%2=0"), ("mask_subtract", S.mask_subtract, "v%3=0 AND v%2<>0"), ("mask_intersect", S.mask_intersect, "v%3=0 AND v%2=0")):
    query(_name, f"SELECT image_id, x, y FROM emb_gray WHERE {_where}")(lambda spark, d, op=_op: op(*_masks(spark, d)))


@query("mask_invert", "WITH m AS (SELECT image_id, x, y FROM emb_gray WHERE v%3=0), b AS (SELECT image_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM m GROUP BY image_id) SELECT p.image_id, p.x, p.y FROM emb_gray p JOIN b ON b.image_id=p.image_id AND p.x BETWEEN x1 AND x2 AND p.y BETWEEN y1 AND y2 WHERE v%3<>0")
def mask_invert(spark, d):
    return S.mask_invert(_masks(spark, d)[0])


# tiles

_CELLS = "cells AS (SELECT image_id, x//2 AS u, y//2 AS w, string_agg(CAST(CASE WHEN v>=128 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY y, x) AS tile FROM emb_gray GROUP BY image_id, x//2, y//2)"
_SET = "ts AS (SELECT image_id, tile, row_number() OVER (PARTITION BY image_id ORDER BY min(w*4+u)) AS tile_index FROM cells WHERE tile<>'0,0,0,0' GROUP BY image_id, tile)"


def _tiles(spark, d):
    bits = X.emb_gray(spark, d).withColumn("v", F.when(F.col("v") >= 128, 1).otherwise(0))
    return S.number_tiles(S.cut_tiles(bits, 2, 2))


@query("tile_extract", f"WITH {_CELLS}, {_SET} SELECT c.image_id, c.u, c.w, coalesce(ts.tile_index, 0) AS tile_index FROM cells c LEFT JOIN ts ON ts.image_id=c.image_id AND ts.tile=c.tile")
def tile_extract(spark, d):
    return _tiles(spark, d)[1]


@query("tile_histogram", f"WITH {_CELLS}, {_SET} SELECT c.image_id, ts.tile_index, count(*) AS n FROM cells c JOIN ts ON ts.image_id=c.image_id AND ts.tile=c.tile GROUP BY ALL")
def tile_histogram(spark, d):
    return _tiles(spark, d)[1].filter("tile_index > 0").groupBy("image_id", "tile_index").agg(F.count("*").alias("n"))


@query("tile_pack", f"WITH {_CELLS}, {_SET}, u AS (SELECT DISTINCT c.image_id, ts.tile_index FROM cells c JOIN ts ON ts.image_id=c.image_id AND ts.tile=c.tile WHERE c.u > 0) SELECT image_id, tile_index, row_number() OVER (PARTITION BY image_id ORDER BY tile_index) AS packed FROM u")
def tile_pack(spark, d):
    return S.pack_tiles(_tiles(spark, d)[1].filter("u > 0"))


@query("unused_tiles", f"WITH {_CELLS}, {_SET} SELECT ts.image_id, ts.tile_index FROM ts WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.image_id=ts.image_id AND c.tile=ts.tile AND c.u>0)")
def unused_tiles(spark, d):
    tileset, tilemap = _tiles(spark, d)
    return L.used_entries(tileset.select("image_id", "tile_index"), tilemap.filter("u > 0"), ["image_id", "tile_index"], used=False)


@query("tilemap_render", "SELECT image_id, x, y, CASE WHEN v>=128 THEN 1 ELSE 0 END AS v FROM emb_gray WHERE EXISTS (SELECT 1 FROM emb_gray o WHERE o.image_id=emb_gray.image_id AND o.x//2=emb_gray.x//2 AND o.y//2=emb_gray.y//2 AND o.v>=128)")
def tilemap_render(spark, d):
    tileset, tilemap = _tiles(spark, d)
    drawn = tilemap.filter("tile_index > 0").join(tileset, ["image_id", "tile_index"]).select("image_id", "u", "w", F.posexplode(F.split("tile", ",")).alias("p", "c"))
    return drawn.select("image_id", (F.col("u") * 2 + F.col("p") % 2).alias("x"), (F.col("w") * 2 + F.floor(F.col("p") / 2)).alias("y"), F.col("c").cast("int").alias("v"))


@query("tilemap_render_flips", f"WITH {_CELLS}, {_SET}, m AS (SELECT c.image_id, c.u, c.w, ts.tile, c.u%2=1 AS fx, c.w%2=1 AS fy, (c.u+c.w)%3=0 AS fd FROM cells c JOIN ts ON ts.image_id=c.image_id AND ts.tile=c.tile), t AS (SELECT m.*, i%2 AS x, i//2 AS y, CASE WHEN fx THEN 1-i%2 ELSE i%2 END AS px, CASE WHEN fy THEN 1-i//2 ELSE i//2 END AS py FROM m, range(4) r(i)) SELECT image_id, u*2+x AS x, w*2+y AS y, CAST(string_split(tile, ',')[1+CASE WHEN fd THEN px*2+py ELSE py*2+px END] AS BIGINT) AS v FROM t")
def tilemap_render_flips(spark, d):
    """Cells flipped by their place in the map."""
    tileset, tilemap = _tiles(spark, d)
    flips = {"flip_x": F.col("u") % 2 == 1, "flip_y": F.col("w") % 2 == 1, "flip_d": (F.col("u") + F.col("w")) % 3 == 0}
    each = tileset.select("image_id", "tile_index", F.posexplode(F.split("tile", ",")).alias("p", "c"))
    tiles = each.select("image_id", "tile_index", (F.col("p") % 2).alias("x"), F.floor(F.col("p") / 2).alias("y"), F.col("c").cast("int").alias("v"))
    return S.draw_tiles(tilemap.withColumns(flips), tiles, 2)
