"""Further forms of the operators: other edges, shapes, flips, bands, file forms and levels."""

from pyspark.sql import functions as F

from spritespark.operators import grouped as G
from spritespark.operators import lookups as L
from spritespark.operators import neighbors as N
from spritespark.operators import sheets as H
from spritespark.operators import structure as S
from spritespark.queries.registry import query
from spritespark.queries.structure import _CELLS
from spritespark.sources import files
from spritespark.sources import fixtures as X


def _taps(size, at):
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN a>0 THEN {c} ELSE 0 END)//nullif({size * size}-sum(CASE WHEN a>0 THEN 0 ELSE 1 END),0),0) AS BIGINT) AS {c}" for c in "rgb")
    half = size // 2
    return f"WITH k AS (SELECT i.i AS dx, j.j AS dy FROM range(-{half},{half + 1}) i(i), range(-{half},{half + 1}) j(j)), t AS (SELECT p.image_id, p.x AS tx, p.y AS ty, q.r, q.g, q.b, q.a FROM emb_rgba p, k JOIN emb_rgba q ON true WHERE q.image_id=p.image_id AND q.x={at('p.x+k.dx')} AND q.y={at('p.y+k.dy')}) SELECT image_id, tx AS x, ty AS y, {sums}, CAST(sum(a)//{size * size} AS BIGINT) AS a FROM t GROUP BY image_id, tx, ty"


@query("convolve_wrap", _taps(3, lambda e: f"({e}+8)%8"))
def convolve_wrap(spark, d):
    return N.convolve(X.emb_rgba(spark, d), 8, 8, [[1] * 3] * 3, wrap=True)


@query("convolve_large", _taps(7, lambda e: f"greatest(0,least(7,{e}))"))
def convolve_large(spark, d):
    """Beyond 5 by 5, one array an image instead of a row for each weight."""
    return G.convolve_images(X.emb_rgba(spark, d), [[1] * 7] * 7)


for _shape, _near in (("square", "greatest(abs(q.x-p.x),abs(q.y-p.y))=1"), ("horizontal", "q.y=p.y AND abs(q.x-p.x)=1"), ("vertical", "q.x=p.x AND abs(q.y-p.y)=1")):
    query(f"outline_inside_{_shape}", f"SELECT p.image_id, p.x, p.y, CASE WHEN p.a>0 AND EXISTS (SELECT 1 FROM emb_rgba q WHERE q.image_id=p.image_id AND q.a=0 AND {_near}) THEN 9 ELSE r END AS r, g, b, a FROM emb_rgba p")(lambda spark, d, shape=_shape: N.outline(X.emb_rgba(spark, d), {"r": 9}, shape, inside=True))


def _pass(k):
    """SQL of one pass over o{k}."""
    return f"t{k} AS (SELECT p.image_id, p.x, p.y, p.v AS own, n.v, abs(n.x-p.x)+abs(n.y-p.y)=1 AS close FROM o{k} p JOIN o{k} n ON n.image_id=p.image_id AND abs(n.x-p.x)<=1 AND abs(n.y-p.y)<=1 AND NOT (n.x=p.x AND n.y=p.y)), c{k} AS (SELECT image_id, x, y, own, v, count(*) AS n, bool_or(close AND v=own) AS l FROM t{k} GROUP BY image_id, x, y, own, v), w{k} AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY n DESC, v) AS k, bool_or(l) OVER (PARTITION BY image_id, x, y) AS alike FROM c{k}), o{k + 1} AS (SELECT image_id, x, y, CASE WHEN NOT alike AND n>=4 THEN v ELSE own END AS v FROM w{k} WHERE k=1)"


@query("remove_orphans_twice", f"WITH o0 AS (SELECT image_id, x, y, v//64 AS v FROM emb_gray), {_pass(0)}, {_pass(1)} SELECT image_id, x, y, v FROM o2")
def remove_orphans_twice(spark, d):
    return N.remove_orphans(X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 64).alias("v")), 8, 8, passes=2)


@query("cell_purity_best", "WITH g AS (SELECT p.p, o.o FROM (SELECT unnest([2,3,4]) AS p) p, range(4) o(o) WHERE o.o < p.p), c AS (SELECT image_id, g.p, g.o, (x+g.o)//g.p AS cx, (y+g.o)//g.p AS cy, v//32 AS v, count(*) AS n FROM emb_gray, g GROUP BY ALL), m AS (SELECT image_id, p, o, cx, cy, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL), s AS (SELECT image_id, p AS pitch, o AS phase, round(sum(most)/sum(n), 6) AS purity FROM m GROUP BY image_id, p, o) SELECT image_id, pitch, phase, purity FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY purity DESC, pitch DESC, phase) AS k FROM s) WHERE k=1")
def cell_purity_best(spark, d):
    p = X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 32).alias("v"))
    return N.best_grid(N.cell_purity(p, [2, 3, 4]))


@query("border_model_kind", "WITH c AS (SELECT image_id, x, y, v//128 AS r, 0 AS g, CASE WHEN v<40*(image_id%7) THEN 0 ELSE 255 END AS a FROM emb_gray), e AS (SELECT image_id, r, a, count(*) AS n FROM c WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY image_id, r, a), s AS (SELECT image_id, sum(CASE WHEN a=0 THEN n ELSE 0 END)/sum(n) AS clear, max(n)/sum(n) AS share FROM e GROUP BY image_id) SELECT image_id, CASE WHEN clear>0.9 THEN 'transparent' WHEN share>=0.8 THEN 'flat' ELSE 'set' END AS kind, round(share, 6) AS share FROM s")
def border_model_kind(spark, d):
    alpha = F.when(F.col("v") < 40 * (F.col("image_id") % 7), 0).otherwise(255)
    p = X.emb_gray(spark, d).select("image_id", "x", "y", F.floor(F.col("v") / 128).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), alpha.alias("a"))
    return N.background_kind(p, 8, 8).withColumn("share", F.round("share", 6))


_BANDS = "WITH s AS (SELECT *, item%4//2 AS layer FROM samples), f AS (SELECT *, CASE WHEN layer IS NOT DISTINCT FROM lag(layer) OVER (PARTITION BY sheet ORDER BY item) THEN 0 ELSE 1 END AS new FROM s), n AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY item) AS band FROM f), m AS (SELECT sheet, band, max(h) AS most FROM n GROUP BY ALL), o AS (SELECT sheet, band, coalesce(sum(most+1) OVER (PARTITION BY sheet ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS y FROM m) SELECT n.sheet, n.item, CAST(coalesce(sum(w+1) OVER (PARTITION BY n.sheet, n.band ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS x, CAST(o.y AS BIGINT) AS y FROM n JOIN o ON o.sheet=n.sheet AND o.band=n.band"


@query("sheet_layout_bands", _BANDS)
def sheet_layout_bands(spark, d):
    """A row for each run of samples of one layer."""
    s = X.samples(spark, d).withColumn("layer", F.floor(F.col("item") % 4 / 2))
    return H.layout_rows(s, None, padding=1, by="layer").select("sheet", "item", "x", "y")


def _sheet_frames(spark, d):
    return X.frames_tbl(spark, d).select("*", F.format_string("f%d", "frame").alias("name"), (F.col("frame") * 32).alias("x"), F.lit(0).alias("y"), F.lit(32).alias("w"), F.lit(16).alias("h"))


_WAY = "['forward','reverse','pingpong','pingpong_reverse'][1+dir]"
_SHEET = f"""WITH f AS (SELECT sprite_id, string_agg('"f' || frame || '":{{"frame":{{"x":' || 32*frame || ',"y":0,"w":32,"h":16}},"rotated":false,"trimmed":false,"duration":' || duration_ms || '}}', ',' ORDER BY frame) AS s, 32*(max(frame)+1) AS w FROM frames_tbl GROUP BY sprite_id), t AS (SELECT sprite_id, string_agg('{{"name":"t' || tag_id || '","from":' || from_frame || ',"to":' || to_frame || ',"direction":"' || {_WAY} || '"}}', ',' ORDER BY tag_id) AS s FROM tags_tbl GROUP BY sprite_id) SELECT f.sprite_id, '{{"frames":{{' || f.s || '}},"meta":{{"size":{{"w":' || w || ',"h":16}},"frameTags":[' || t.s || ']}}}}' AS json FROM f JOIN t ON t.sprite_id=f.sprite_id"""


@query("sink_sheet_json_meta", _SHEET)
def sink_sheet_json_meta(spark, d):
    return H.sheet_json(_sheet_frames(spark, d), X.tags_tbl(spark, d).withColumn("name", F.format_string("t%d", "tag_id")))


@query("src_sheet_json_hash", "SELECT sprite_id, 'f' || frame AS name, 32*frame AS x, 0 AS y, 32 AS w, 16 AS h, duration_ms FROM frames_tbl")
def src_sheet_json_hash(spark, d):
    """Frames listed by name, written and read again."""
    return H.read_sheet_json(H.sheet_json(_sheet_frames(spark, d)))


@query("sink_user_data_groups", """SELECT event_id AS id, CASE WHEN user_id%4=3 THEN NULL ELSE '{' || CASE WHEN user_id%4 IN (0,1) THEN '"k":"' || user_id || '"' ELSE '' END || CASE WHEN user_id%4=0 THEN ',' ELSE '' END || CASE WHEN user_id%4 IN (0,2) THEN '"a/b":{"e":"' || event_type || '"}' ELSE '' END || '}' END AS json FROM events""")
def sink_user_data_groups(spark, d):
    """Properties of the nameless group, of a named one, of both, of none."""
    kind, none = F.col("user_id") % 4, F.expr("map_from_arrays(array(), array())").cast("map<string,string>")
    own = F.when(kind.isin(0, 1), F.create_map(F.lit("k"), F.col("user_id").cast("string"))).otherwise(none)
    named = F.when(kind.isin(0, 2), F.create_map(F.lit("e"), F.col("event_type"))).otherwise(none)
    rows = X.table(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit(""), own, F.lit("a/b"), named).alias("groups"))
    return rows.select("id", files.properties_json().alias("json"))


@query("sink_palette_hex", "SELECT sprite_id, frame_from, string_agg(printf('%02x%02x%02x', r, g, b), chr(10) ORDER BY idx) || chr(10) AS hex FROM palettes_asof GROUP BY sprite_id, frame_from")
def sink_palette_hex(spark, d):
    return files.palette_hex(X.palettes_asof(spark, d), ["sprite_id", "frame_from"])


@query("sink_palette_act", "SELECT sprite_id, frame_from, idx, r, g, b FROM palettes_asof WHERE idx < 100 + sprite_id%50")
def sink_palette_act(spark, d):
    """Written with the count of its entries, and parsed again."""
    written = files.palette_act(X.palettes_asof(spark, d).filter("idx < 100 + sprite_id % 50"), ["sprite_id", "frame_from"])
    part = F.split("file", "/")
    parsed = files.parse_act(written.select(F.concat_ws("/", "sprite_id", "frame_from").alias("file"), F.col("act").alias("content")))
    return parsed.select(part[0].cast("long").alias("sprite_id"), part[1].cast("long").alias("frame_from"), "idx", "r", "g", "b")


_FORMS = "f AS (SELECT *, [" + ", ".join("'' || " + " || ',' || ".join(f"string_split(tile,',')[{i + 1}]" for i in S.flipped(2, f)) for f in S.FLIPS) + "] AS forms FROM cells), k AS (SELECT *, list_min(forms) AS cls FROM f), o AS (SELECT image_id, cls, min(w*4+u) AS spot, arg_min(tile, w*4+u) AS own FROM k WHERE tile<>'0,0,0,0' GROUP BY image_id, cls), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY spot) AS tile_index FROM o)"


@query("tile_match_flips", f"WITH {_CELLS}, {_FORMS} SELECT k.image_id, k.u, k.w, coalesce(n.tile_index, 0) AS tile_index, coalesce({list(S.FLIPS)}[list_position(k.forms, n.own)], '') AS flip FROM k LEFT JOIN n ON n.image_id=k.image_id AND n.cls=k.cls")
def tile_match_flips(spark, d):
    """All eight forms of a tile."""
    bits = X.emb_gray(spark, d).withColumn("v", F.when(F.col("v") >= 128, 1).otherwise(0))
    return S.match_tiles(S.cut_tiles(bits, 2, 2), 2)


@query("pick_cels_bounds", "SELECT e.event_id AS point_id, max(p.frame) AS z FROM events e JOIN anim_rgba p ON p.sprite_id=e.user_id%100 AND p.x=e.event_id%32 AND p.y=(e.event_id//32)%16 WHERE p.a>0 GROUP BY e.event_id")
def pick_cels_bounds(spark, d):
    e = F.col("event_id")
    points = X.table(spark, d, "events").select(e.alias("point_id"), (F.col("user_id") % 100).alias("sprite_id"), (e % 32).alias("x"), (F.floor(e / 32) % 16).alias("y"))
    return L.pick_cels_by_bounds(points, X.anim_rgba(spark, d).withColumn("z", F.col("frame")), cell=8)


_LEVELS = {
    "durations": ("frames_tbl", "frame", "duration_ms", "frame%4<>3", "CASE WHEN frame%3=0 THEN duration_ms+1 ELSE duration_ms END"),
    "tags": ("tags_tbl", "tag_id", "to_frame", "tag_id<>1", "CASE WHEN sprite_id%2=0 THEN to_frame+1 ELSE to_frame END"),
    "palettes": ("(SELECT sprite_id, frame_from*256+idx AS entry, r*65536+g*256+b AS rgb FROM palettes_asof)", "entry", "rgb", "entry%5<>0 OR sprite_id%3<>0", "CASE WHEN entry%7=0 THEN 0 ELSE rgb END"),
    "cels": ("(SELECT sprite_id, frame*4+layer AS cel, sum(idx)::BIGINT AS content FROM anim GROUP BY ALL)", "cel", "content", "cel%3<>0", "content + cel%2"),
    "canvas": ("(SELECT sprite_id, 0 AS canvas, max(y) AS height FROM anim GROUP BY sprite_id)", "canvas", "height", "sprite_id%9<>0", "CASE WHEN sprite_id%2=0 THEN height+2 ELSE height END"),
}
_DIFF = " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS level, a.sprite_id, 0 AS added, count(*) FILTER (WHERE b.sprite_id IS NULL) AS removed, count(*) FILTER (WHERE b.{v}<>a.{v}) AS changed FROM {t} a LEFT JOIN (SELECT sprite_id, {k}, {e} AS {v} FROM {t} WHERE {w}) b ON b.sprite_id=a.sprite_id AND b.{k}=a.{k} GROUP BY a.sprite_id) WHERE removed+changed>0" for n, (t, k, v, w, e) in _LEVELS.items())


@query("sprite_diff_levels", _DIFF)
def sprite_diff_levels(spark, d):
    """Durations, tags, palettes, cels and canvases of a corpus and of an edited one."""
    p, a = X.palettes_asof(spark, d), X.anim(spark, d)
    of = {
        "durations": X.frames_tbl(spark, d),
        "tags": X.tags_tbl(spark, d),
        "palettes": p.select("sprite_id", (F.col("frame_from") * 256 + F.col("idx")).alias("entry"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("rgb")),
        "cels": a.groupBy("sprite_id", (F.col("frame") * 4 + F.col("layer")).alias("cel")).agg(F.sum("idx").alias("content")),
        "canvas": a.groupBy("sprite_id").agg(F.max("y").alias("height")).withColumn("canvas", F.lit(0)),
    }
    return L.sprite_differences({n: (of[n], of[n].filter(w).withColumn(v, F.expr(e)), ["sprite_id", k], [v]) for n, (_, k, v, w, e) in _LEVELS.items()})


@query("remap_invertible", "SELECT sprite_id, count(DISTINCT dst)=count(*) AS invertible FROM (SELECT DISTINCT sprite_id, idx, idx*5%(60+sprite_id%100) AS dst FROM anim) GROUP BY sprite_id")
def remap_invertible(spark, d):
    used = X.anim(spark, d).select("sprite_id", F.col("idx").alias("src")).distinct()
    return L.invertible(used.withColumn("dst", F.col("src") * 5 % (60 + F.col("sprite_id") % 100)), ("sprite_id",))


@query("layer_filter_names", "WITH one AS (SELECT min(path) AS path FROM layer_tree WHERE name='NATION_3' HAVING count(*)=1) SELECT t.layer_id, t.path FROM layer_tree t WHERE (t.path LIKE 'ASIA/%' OR t.path LIKE 'EUROPE/%') AND t.path<>coalesce((SELECT path FROM one), 'NATION_3') AND NOT starts_with(t.path, coalesce((SELECT path FROM one), 'NATION_3') || '/')")
def layer_filter_names(spark, d):
    """A bare name stands for the only layer that has it, and excludes what is below it."""
    return S.filter_layers(S.layer_paths(X.layer_tree(spark, d)), ["ASIA/*", "EUROPE/*"], ["NATION_3"]).select("layer_id", "path")


_LINEAR = "((x-1)*5+(y-1)*4)/41.0::DOUBLE"
_RADIAL = "sqrt(((x-3.5::DOUBLE)/3.5::DOUBLE)*((x-3.5::DOUBLE)/3.5::DOUBLE)+((y-3::DOUBLE)/2.0::DOUBLE)*((y-3::DOUBLE)/2.0::DOUBLE))"
_FIRST, _LAST = {"r": 10, "g": 250, "b": 0, "a": 255}, {"r": 210, "g": 10, "b": 99, "a": 100}


def _stops(f):
    return f"WITH t AS (SELECT image_id, x, y, {f} AS f FROM emb_gray) SELECT image_id, x, y, " + ", ".join(f"CASE WHEN f<0 THEN {_FIRST[c]} WHEN f>1 THEN {_LAST[c]} ELSE CAST(floor({_FIRST[c]}+f*({_LAST[c] - _FIRST[c]})+1e-7) AS BIGINT) END AS {c}" for c in "rgba") + " FROM t"


@query("gradient_fill_angle", _stops(_LINEAR))
def gradient_fill_angle(spark, d):
    return N.gradient_between(X.emb_gray(spark, d).select("image_id", "x", "y"), (1, 1), (6, 5), _FIRST, _LAST)


@query("gradient_fill_radial", _stops(_RADIAL))
def gradient_fill_radial(spark, d):
    return N.gradient_between(X.emb_gray(spark, d).select("image_id", "x", "y"), (0, 1), (7, 5), _FIRST, _LAST, radial=True)


_ROUGH = "([0,2,3,1][1+(y%2)*2+x%2]*4 + [0,2,3,1][1+((y//2)%2)*2+(x//2)%2])"


@query("gradient_fill_dither", f"WITH t AS (SELECT image_id, x, y, {_LINEAR}*17 < {_ROUGH}+1 AS low FROM emb_gray) SELECT image_id, x, y, " + ", ".join(f"CASE WHEN low THEN {_FIRST[c]} ELSE {_FIRST[c] if c != 'a' else 0} END AS {c}" for c in "rgba") + " FROM t")
def gradient_fill_dither(spark, d):
    """Towards a transparent colour, which has the first one's channels."""
    return N.gradient_between(X.emb_gray(spark, d).select("image_id", "x", "y"), (1, 1), (6, 5), _FIRST, _LAST | {"a": 0}, matrix=N.bayer(4))


_W = {"r": 2126, "g": 7152, "b": 722, "a": 20000}
_USED = {c: "q.a<>n.a0" if c == "a" else f"n.a0>0 AND q.a>0 AND q.{c}<>n.{c}0" for c in "rgba"}
_MIX = f"greatest(0, least(15, coalesce(({'+'.join(f'CASE WHEN {_USED[c]} THEN {w * 15}*(n.{c}-n.{c}0)//(q.{c}-n.{c}0) ELSE 0 END' for c, w in _W.items())})//nullif({'+'.join(f'CASE WHEN {_USED[c]} THEN {w} ELSE 0 END' for c, w in _W.items())},0),0)))"


def _apart(x, y):
    return f"(CASE WHEN a{x}>0 AND a{y}>0 THEN abs(r{x}-r{y})*2126+abs(g{x}-g{y})*7152+abs(b{x}-b{y})*722 ELSE 0 END+abs(a{x}-a{y})*20000)"


_PAIRS = f"c AS (SELECT DISTINCT r, g, b, a FROM emb_rgba WHERE a>0), q AS (SELECT * FROM pal256 WHERE idx<>32), m AS (SELECT c.*, q.idx, q.r AS r0, q.g AS g0, q.b AS b0, q.a AS a0, row_number() OVER (PARTITION BY c.r, c.g, c.b, c.a ORDER BY 900*((c.r>>3)-(q.r>>3))*((c.r>>3)-(q.r>>3))+3481*((c.g>>3)-(q.g>>3))*((c.g>>3)-(q.g>>3))+121*((c.b>>3)-(q.b>>3))*((c.b>>3)-(q.b>>3))+64*((c.a>>3)-(q.a>>3))*((c.a>>3)-(q.a>>3)), q.idx) AS k FROM c, q), n AS (SELECT * FROM m WHERE k=1), x1 AS (SELECT n.*, q.idx AS other, q.r AS r1, q.g AS g1, q.b AS b1, q.a AS a1, {_MIX} AS mix FROM n, q), x2 AS (SELECT *, " + ", ".join(f"{c}0+({c}1-{c}0)*mix//15 AS {c}m" for c in "rgba") + f" FROM x1), x3 AS (SELECT *, row_number() OVER (PARTITION BY r, g, b, a ORDER BY {_apart('', 'm')}+{_apart('0', '1')}//10, other) AS best FROM x2)"


@query("dither_ordered_palette", f"WITH {_PAIRS} SELECT p.image_id, p.x, p.y, CASE WHEN z.idx IS NULL THEN 32 WHEN {_ROUGH.replace('x', 'p.x').replace('y', 'p.y')} < z.mix THEN z.other ELSE z.idx END AS idx FROM emb_rgba p LEFT JOIN x3 z ON z.best=1 AND z.r=p.r AND z.g=p.g AND z.b=p.b AND z.a=p.a")
def dither_ordered_palette(spark, d):
    """Two entries a colour, searched once for each distinct colour."""
    p = X.emb_rgba(spark, d)
    pairs = L.dither_pairs(p, X.pal256(spark), 15, 32)
    pick = F.when(F.col("idx").isNull(), 32).when(N.matrix_at(N.bayer(4)) < F.col("mix"), F.col("other")).otherwise(F.col("idx"))
    return p.join(pairs, list("rgba"), "left").select("image_id", "x", "y", pick.alias("idx"))


_MASKED = "e AS (SELECT image_id, r, g, b, a, count(*) AS n FROM emb_rgba WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY image_id, r, g, b, a), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b, a) AS k FROM e) WHERE k<=3), d AS (SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, CASE WHEN p.a=0 THEN 0 ELSE min((p.r-m.r)*(p.r-m.r)+(p.g-m.g)*(p.g-m.g)+(p.b-m.b)*(p.b-m.b)+(p.a-m.a)*(p.a-m.a)) END AS d FROM emb_rgba p JOIN m ON m.image_id=p.image_id GROUP BY p.image_id, p.x, p.y, p.r, p.g, p.b, p.a), ok AS (SELECT image_id, x, y FROM d WHERE d<=60*60)"
_SOFT = "SELECT d.image_id, d.x, d.y, d.r, d.g, d.b, CASE WHEN c.x IS NOT NULL THEN 0 WHEN sqrt(d.d)>60 AND sqrt(d.d)<140 AND EXISTS (SELECT 1 FROM {c} s WHERE s.image_id=d.image_id AND s.y=d.y AND abs(s.x-d.x)=1) THEN CAST(floor(d.a*((sqrt(d.d)-60)/80)+0.5) AS BIGINT) ELSE d.a END AS a FROM d LEFT JOIN {c} c ON c.image_id=d.image_id AND c.x=d.x AND c.y=d.y"


def _model(p):
    return N.border_shares(p, 8, 8, least=0.0, most=3).select("image_id", *(F.col(c).alias(f"m{c}") for c in "rgba"))


@query("bg_remove_soft", f"WITH {_MASKED} {_SOFT.format(c='ok')}")
def bg_remove_soft(spark, d):
    p = X.emb_rgba(spark, d)
    return N.background_masked(p, _model(p), 60, soft=140)


@query("bg_remove_connected", f"WITH RECURSIVE {_MASKED}, hit AS (SELECT image_id, x, y FROM ok WHERE x=0 OR y=0 OR x=7 OR y=7 UNION SELECT ok.image_id, ok.x, ok.y FROM hit JOIN ok ON ok.image_id=hit.image_id AND abs(ok.x-hit.x)+abs(ok.y-hit.y)=1) {_SOFT.format(c='hit')}")
def bg_remove_connected(spark, d):
    p = X.emb_rgba(spark, d)
    return N.background_masked(p, _model(p), 60, soft=140, width=8, height=8, connected=True)


_SIZES = [(1, 1), (2, 1), (1, 2), (2, 2), (4, 4), (8, 8)]
_STEPS = ", ".join(f"b{k + 1} AS (SELECT image_id, CASE WHEN s{k}>=0.55 AND (best IS NULL OR s{k}>bs+0.05) THEN {k} ELSE best END AS best, CASE WHEN s{k}>=0.55 AND (best IS NULL OR s{k}>bs+0.05) THEN s{k} ELSE bs END AS bs, * EXCLUDE (image_id, best, bs) FROM b{k})" for k in range(len(_SIZES)))
_SCORES = "s AS (SELECT unnest([" + ",".join(f"{{'k':{k},'p':{p},'q':{q}}}" for k, (p, q) in enumerate(_SIZES)) + "]) AS g), c AS (SELECT image_id, g.k AS k, x%g.p AS u, y%g.q AS w, v//64 AS v, count(*) AS n FROM emb_gray, s WHERE x=0 OR y=0 OR x=7 OR y=7 GROUP BY ALL), m AS (SELECT image_id, k, u, w, max(n) AS most, sum(n) AS n FROM c GROUP BY ALL), t AS (SELECT image_id, k, sum(most)/sum(n) AS score FROM m GROUP BY image_id, k), b0 AS (SELECT image_id, CAST(NULL AS BIGINT) AS best, CAST(NULL AS DOUBLE) AS bs, " + ", ".join(f"max(score) FILTER (WHERE k={k}) AS s{k}" for k in range(len(_SIZES))) + " FROM t GROUP BY image_id)"


@query("border_tile_choice", f"WITH {_SCORES}, {_STEPS} SELECT image_id, {[p for p, _ in _SIZES]}[best+1] AS p, {[q for _, q in _SIZES]}[best+1] AS q, round(bs, 6) AS score FROM b{len(_SIZES)} WHERE best IS NOT NULL")
def border_tile_choice(spark, d):
    p = X.emb_gray(spark, d).withColumn("v", F.floor(F.col("v") / 64))
    return N.tile_choice(p, 8, 8, _SIZES).withColumn("score", F.round("score", 6))


@query("palette_octree_reduced")
def palette_octree_reduced(spark, d):
    """At most 24 colours a sprite from its octree's leaves."""
    return G.octree_palette(G.octree_sums(X.anim_rgba(spark, d)), 24)
