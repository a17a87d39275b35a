"""Palette files, image files and user data: parsed and written with Spark's readers, writers and string functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_gpl(lines: DataFrame) -> DataFrame:
    """lines: file, line_no, line. (file, idx, r, g, b, name) of the entries of a text palette; other lines are skipped."""
    entry = r"^\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})(?:\s+(.*?))?\s*$"
    rows = lines.filter(F.col("line").rlike(entry))
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    return rows.select("file", at.alias("idx"), *(F.regexp_extract("line", entry, i + 1).cast("int").alias(c) for i, c in enumerate("rgb")), F.regexp_extract("line", entry, 4).alias("name"))


def parse_hex(lines: DataFrame) -> DataFrame:
    """One colour per line, as six hexadecimal digits."""
    from pyspark.sql import Window

    rows = lines.filter(F.col("line").rlike("^#?[0-9A-Fa-f]{6}$")).withColumn("h", F.regexp_replace("line", "#", ""))
    at = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    return rows.select("file", at.alias("idx"), *(F.conv(F.substring("h", 1 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; each is read whole, palettes being a few hundred lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return files


def parse_pal(lines: DataFrame) -> DataFrame:
    """lines: file, line_no (from 0), line. (file, idx, r, g, b, a) of files whose first two lines are JASC-PAL and 0100.

    Alpha is 255 where a line has three numbers; empty lines are skipped, the third line's count is not used.
    """
    from pyspark.sql import Window

    entry = r"^\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})(?:\s+(\d{1,3}))?\s*$"
    head = lines.filter("line_no < 2").groupBy("file").agg(F.max(F.when(F.col("line_no") == 0, F.trim("line"))).alias("kind"), F.max(F.when(F.col("line_no") == 1, F.trim("line"))).alias("version"))
    good = head.filter("kind = 'JASC-PAL' AND version = '0100'").select("file")
    rows = lines.filter((F.col("line_no") > 2) & F.col("line").rlike(entry)).join(good, "file", "left_semi")
    at = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    channels = [F.regexp_extract("line", entry, i + 1) for i in range(4)]
    return rows.select("file", at.alias("idx"), *(F.when(v == "", 255).otherwise(v.try_cast("int")).alias(c) for c, v in zip("rgba", channels, strict=True)))


def read_act(spark: SparkSession, path: str) -> DataFrame:
    return parse_act(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def parse_act(files: DataFrame) -> DataFrame:
    """files: file, content. 256 entries of three bytes; two more bytes, high one first, say how many of them count."""
    raw = files.select("file", F.hex("content").alias("h"))
    given = F.conv(F.substring("h", 256 * 6 + 1, 4), 16, 10).cast("int")
    most = F.when(F.length("h") >= 257 * 6 - 2, F.least(F.lit(256), given)).otherwise(256)
    each = raw.select("file", "h", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"), most.alias("most")).filter("idx < most")
    return each.select("file", "idx", *(F.conv(F.substr("h", F.col("idx") * 6 + 1 + 2 * i, F.lit(2)), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")))


def palette_text(palette: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gpl): a palette's entries as the text of one file."""
    line = F.format_string("%3d %3d %3d\tIndex %d", "r", "g", "b", "idx")
    body = palette.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    return body.select(*keys, F.concat(F.lit("GIMP Palette\n#\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("gpl"))


def palette_hex(palette: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hex): one colour a line, as six hexadecimal digits."""
    line = F.lower(F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb")))
    body = palette.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    return body.select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("hex"))


def palette_act(palette: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, act): 256 entries of three bytes, absent ones black at the end, then how many there are and no transparent one."""
    entry = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    body = palette.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", entry.alias("e")))).alias("l"))
    digits = F.concat(F.rpad(F.array_join(F.transform("l", lambda x: x["e"]), ""), 256 * 6, "0"), F.lpad(F.hex(F.size("l")), 4, "0"), F.lit("FFFF"))
    return body.select(*keys, F.unhex(digits).alias("act"))


def properties_json(groups: str = "groups"):
    """Property maps by group as one JSON object: those of the group without a name first-hand, others nested, empty ones left out."""
    inner = lambda s: F.substr(s, F.lit(2), F.length(s) - 2)
    some = F.filter(F.map_entries(groups), lambda e: F.size(e["value"]) > 0)
    each = F.transform(some, lambda e: F.when(e["key"] == "", inner(F.to_json(e["value"]))).otherwise(F.concat(inner(F.to_json(F.array(e["key"]))), F.lit(":"), F.to_json(e["value"]))))
    return F.when(F.size(some) > 0, F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}")))


def user_data_json(rows: DataFrame) -> DataFrame:
    """rows: id, text, color (BIGINT rgba), properties (MAP). (id, json), without what is empty; colours as #rrggbbaa."""
    from spritespark.functions.color import unpack_rgba

    c = F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(x), 2, "0") for x in unpack_rgba("color"))))
    return rows.select("id", F.to_json(F.struct(F.when(F.col("text") != "", F.col("text")).alias("data"), F.when(F.col("color") != 0, c).alias("color"), F.when(F.size("properties") > 0, F.col("properties")).alias("properties"))).alias("json"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of Spark's image source as pixel rows: origin, x, y, r, g, b, a. Rows of a picture are exploded in its task."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = i.select("origin", "width", "nChannels", F.hex("data").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    byte = lambda k: F.conv(F.substr("h", (F.col("i") * F.col("nChannels") + k) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("origin", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).alias("y"), byte(F.when(F.col("nChannels") > 2, 2).otherwise(0)).alias("r"), byte(F.when(F.col("nChannels") > 2, 1).otherwise(0)).alias("g"), byte(F.lit(0)).alias("b"), F.when(F.col("nChannels") == 4, byte(F.lit(3))).otherwise(255).alias("a"))


_KERNEL = r"(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\{([^}]*)\}\s*(\S+)\s+(\S+)\s+([rgba]+)"


def parse_kernels(texts: DataFrame) -> DataFrame:
    """texts (file, text) -> (file, place, name, w, h, cx, cy, weights, div, bias, target): named matrices ``name w h cx cy { weights } div bias target``.

    From # on a line is a comment. An automatic divisor is the weights' sum; where that is negative it is its absolute value and the automatic bias
    255, where it is 0 the divisor is 1 and the bias 128. A matrix with another number of weights than w * h is left out.
    """
    clean = F.regexp_replace("text", "#[^\n]*", "")
    part = [F.regexp_extract_all(clean, F.lit(_KERNEL), F.lit(i)).alias(f"k{i}") for i in range(1, 10)]
    rows = texts.select("file", F.posexplode(F.arrays_zip(*part)).alias("place", "k")).select("file", "place", "k.*")
    rows = rows.withColumn("weights", F.transform(F.filter(F.split("k6", r"\s+"), lambda v: v != ""), lambda v: v.cast("int")))
    total = F.aggregate("weights", F.lit(0), lambda a, v: a + v)
    div = F.when(F.col("k7") != "auto", F.col("k7").try_cast("int")).otherwise(F.when(total == 0, 1).otherwise(F.abs(total)))
    bias = F.when(F.col("k8") != "auto", F.col("k8").try_cast("int")).otherwise(F.when((F.col("k7") != "auto") | (total > 0), 0).when(total < 0, 255).otherwise(128))
    out = rows.select("file", "place", F.col("k1").alias("name"), *(F.col(f"k{i}").cast("int").alias(n) for i, n in enumerate(("w", "h", "cx", "cy"), 2)), "weights", div.alias("div"), bias.alias("bias"), F.col("k9").alias("target"))
    return out.filter(F.size("weights") == F.col("w") * F.col("h"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only on a local master where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, by: str | None = None) -> None:
    """Each table as Parquet under the path, partitioned where a column is named."""
    for name, df in tables.items():
        w = df.write.mode("errorifexists")
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{path}/{name}")
