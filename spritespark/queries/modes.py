"""All nine pairs of colour modes, and the other orders of a palette."""

from pyspark.sql import functions as F

from spritespark.operators import modes as M
from spritespark.operators import structure as S
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X

_SOURCES = """s AS (
  SELECT 'rgb' AS f, image_id, x, y, r, g, b, a FROM emb_rgba
  UNION ALL SELECT 'gray', image_id, x, y, v, v, v, CASE WHEN v%5=0 THEN 0 ELSE 255 END FROM emb_gray
  UNION ALL SELECT 'indexed', e.image_id, e.x, e.y, CASE WHEN e.v=130 THEN 0 ELSE p.r END, CASE WHEN e.v=130 THEN 0 ELSE p.g END, CASE WHEN e.v=130 THEN 0 ELSE p.b END, CASE WHEN e.v=130 THEN 0 ELSE p.a END FROM emb_gray e JOIN pal256 p ON p.idx=e.v),
q AS (SELECT * FROM pal256 WHERE idx%16=0 AND idx<>48),
near AS (SELECT c.r, c.g, c.b, c.a, q.idx, row_number() OVER (PARTITION BY c.r, c.g, c.b, c.a ORDER BY ((c.r>>3)-(q.r>>3))*((c.r>>3)-(q.r>>3))*900+((c.g>>3)-(q.g>>3))*((c.g>>3)-(q.g>>3))*3481+((c.b>>3)-(q.b>>3))*((c.b>>3)-(q.b>>3))*121+((c.a>>3)-(q.a>>3))*((c.a>>3)-(q.a>>3))*64, q.idx) AS k FROM (SELECT DISTINCT r, g, b, a FROM s) c JOIN q ON true),
gray AS (SELECT *, CASE WHEN f='gray' THEN r ELSE (r*2126+g*7152+b*722)//10000 END AS v FROM s)"""


@query("convert_mode_pairs", f"WITH {_SOURCES} SELECT f || '-rgb' AS pair, image_id, x, y, r+g*256+b*65536+a::BIGINT*16777216 AS c FROM s UNION ALL SELECT f || '-gray', image_id, x, y, v+a*256 FROM gray UNION ALL SELECT f || '-indexed', image_id, x, y, CASE WHEN s.a>>3=0 THEN 48 ELSE n.idx END FROM s JOIN near n ON n.k=1 AND n.r=s.r AND n.g=s.g AND n.b=s.b AND n.a=s.a")
def convert_mode_pairs(spark, d):
    """From each of three modes to each; 130 is the sources' mask index, 48 that of the sixteen entries."""
    gray = X.emb_gray(spark, d).drop("sprite_id")
    sources = {"rgb": X.emb_rgba(spark, d), "gray": gray.withColumn("a", F.when(F.col("v") % 5 == 0, 0).otherwise(255)), "indexed": gray.withColumnRenamed("v", "idx")}
    packed = {"rgb": "r + g * 256 + b * 65536 + a * 16777216L", "gray": "v + a * 256L", "indexed": "CAST(idx AS BIGINT)"}
    few, out = X.pal256(spark).filter("idx % 16 = 0"), None
    for source, pixels in sources.items():
        for target, c in packed.items():
            got = M.converted(pixels, source, target, X.pal256(spark), 130, few, 48).select(F.lit(f"{source}-{target}").alias("pair"), "image_id", "x", "y", F.expr(c).alias("c"))
            out = got if out is None else out.unionByName(got)
    return out


_VALUES = {
    "hue": "CASE WHEN mx=mn THEN 0.0::DOUBLE ELSE h END", "saturation": "CASE WHEN mx=0 THEN 0.0::DOUBLE ELSE (mx-mn)/mx END",
    "value": "mx", "lightness": "(greatest(r,g,b)+least(r,g,b))//2", "red": "r", "alpha": "a",
}
_HUES = "z AS (SELECT sprite_id, idx, r, g, b, a, r/255.0::DOUBLE AS fr, g/255.0::DOUBLE AS fg, b/255.0::DOUBLE AS fb FROM palettes_asof WHERE frame_from=0), w AS (SELECT *, greatest(fr,fg,fb) AS mx, least(fr,fg,fb) AS mn FROM z), t AS (SELECT *, CASE WHEN mx=fr THEN (fg-fb)/nullif(mx-mn,0) WHEN mx=fg THEN (fb-fr)/nullif(mx-mn,0)+2 ELSE (fr-fg)/nullif(mx-mn,0)+4 END*60 AS h0 FROM w), p AS (SELECT *, CASE WHEN h0<0 THEN h0+360 ELSE h0 END AS h FROM t)"


def _sorted(by: str, descending: bool):
    @query(f"sort_palette_{by}{'_down' if descending else ''}", f"WITH {_HUES} SELECT sprite_id, idx, row_number() OVER (PARTITION BY sprite_id ORDER BY CASE WHEN a=0 THEN 0 ELSE 1 END, {_VALUES[by]} {'DESC' if descending else 'ASC'}, idx)-1 AS place FROM p")
    def run(spark, d):
        return S.sort_palette(X.palettes_asof(spark, d).filter("frame_from = 0"), by, descending, ["sprite_id"]).select("sprite_id", "idx", "place")


for _by, _descending in (("hue", False), ("saturation", True), ("value", False), ("lightness", True), ("red", True), ("alpha", False)):
    _sorted(_by, _descending)
