"""Sprite tables as projections of the given tables: integer arithmetic on text positions, so that keys are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pal256(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(256).select(i.alias("idx"), ((i * 37) % 256).alias("r"), ((i * 91) % 256).alias("g"), ((i * 151) % 256).alias("b"), F.when(i == 32, 0).otherwise(255).alias("a"))


def _characters(df: DataFrame, keys: list, width: int) -> DataFrame:
    rows = df.filter(F.length("text") > 0).select(*keys, F.posexplode(F.split("text", "")).alias("i", "c"))
    names = [c for c in rows.columns if c not in ("i", "c")]
    return rows.select(*names, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), F.ascii("c").alias("idx"))


def doc_pixels(spark: SparkSession, d: str) -> DataFrame:
    """One indexed image per document."""
    return _characters(table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "text"), ["image_id"], 64)


def anim(spark: SparkSession, d: str) -> DataFrame:
    """One layered animation per conversation: frame = turn, layer by role."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.col("turn").cast("int").alias("frame"), F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("layer"), "text")
    return _characters(rows, ["sprite_id", "frame", "layer"], 32)


def with_colors(df: DataFrame) -> DataFrame:
    """Adds the channels of pal256 to indexed pixels, by its rule."""
    i = F.col("idx")
    return df.withColumns({"r": (i * 37) % 256, "g": (i * 91) % 256, "b": (i * 151) % 256, "a": F.when(i == 32, 0).otherwise(255)})


def anim_rgba(spark: SparkSession, d: str) -> DataFrame:
    return with_colors(anim(spark, d))


def emb_gray(spark: SparkSession, d: str) -> DataFrame:
    """An 8x8 gray image per vector."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("sprite_id"), F.posexplode("embedding").alias("p", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5))).cast("int")
    return rows.select("image_id", "sprite_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), v.alias("v"))


def emb_rgba(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return emb_gray(spark, d).select("image_id", "x", "y", v.alias("r"), ((v * 7) % 256).alias("g"), (255 - v).alias("b"), F.when(v % 5 == 0, 0).otherwise(255).alias("a"))


def frames_tbl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("sprite_id"), F.col("turn").cast("int").alias("frame"), (1 + F.length("text") % 500).alias("duration_ms"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sprite_id")).agg(F.count("*").cast("int").alias("n"))


def tags_tbl(spark: SparkSession, d: str) -> DataFrame:
    """Three nested and overlapping tags per conversation."""
    half = F.floor(F.col("n") / 2).cast("int")
    tag = lambda k, a, b, dir_: F.struct(F.lit(k).alias("tag_id"), a.alias("from_frame"), b.alias("to_frame"), dir_.cast("int").alias("dir"))
    three = F.array(tag(0, F.lit(0), F.col("n") - 1, F.col("sprite_id") % 4), tag(1, F.lit(0), half, F.lit(0)), tag(2, half, F.col("n") - 1, F.lit(1)))
    return turns(spark, d).select("sprite_id", F.explode(three).alias("t")).select("sprite_id", "t.*", (F.col("sprite_id") % 3).cast("int").alias("rep"))


def palettes_asof(spark: SparkSession, d: str) -> DataFrame:
    """pal256, rotated by sprite and frame, from frames 0 and 3."""
    rows = turns(spark, d).select("sprite_id", F.explode(F.array(F.lit(0), F.lit(3))).alias("frame_from")).select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    i = ((F.col("idx") + F.col("sprite_id") % 7 + F.col("frame_from")) % 256).cast("int")
    return rows.select("sprite_id", "frame_from", "idx", ((i * 37) % 256).alias("r"), ((i * 91) % 256).alias("g"), ((i * 151) % 256).alias("b"), F.when(i == 32, 0).otherwise(255).alias("a"))


def slice_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).select("sprite_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("frame_from"))
    return rows.select("sprite_id", "frame_from", (F.col("sprite_id") % 5).cast("int").alias("x"), F.col("frame_from").alias("y"), (8 + F.col("frame_from")).alias("w"), F.lit(6).alias("h"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Sheet items: distinct order lines with a size."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("item")).agg((4 + F.min("l_partkey") % 29).cast("int").alias("w"), (4 + F.min("l_suppkey") % 13).cast("int").alias("h"))


def layer_tree(spark: SparkSession, d: str) -> DataFrame:
    """region / nation / supplier as groups and image layers: layer_id, parent_id, level, name, visible."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    shown = lambda c: (F.col(c) % 5 != 0).alias("visible")
    top = r.select((F.col("r_regionkey") + 1_000_000).cast("long").alias("layer_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("level"), F.col("r_name").alias("name"), shown("r_regionkey"))
    mid = n.select((F.col("n_nationkey") + 2_000_000).cast("long"), (F.col("n_regionkey") + 1_000_000).cast("long"), F.lit(1), "n_name", shown("n_nationkey"))
    low = s.select((F.col("s_suppkey") + 3_000_000).cast("long"), (F.col("s_nationkey") + 2_000_000).cast("long"), F.lit(2), "s_name", shown("s_suppkey"))
    return top.union(mid).union(low)
