"""Helpers that the operators of this subpackage share.

Tokens: bytes.lower() and bytes.split() work on ASCII alone, so A-Z is lower-cased
and words are runs of ``[^\\x20\\x09-\\x0D]``, whatever else a text holds.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` gave and that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A group is hot with more than this share of all rows; so there are at most HOT_PARTS hot groups.
HOT_PARTS = 1000


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, small: int = 0) -> DataFrame:
    """rows inner-joined with groups, which has one row for each value of keys, its number of rows in the column ``size``.

    Groups of more than a HOT_PARTS-th of all rows, of which there can be HOT_PARTS at most, are broadcast, so that no
    task gets a hot group; all others meet by shuffle. Both tables are read twice: they should be stored ones.
    With ``small``, groups of so many rows are never hot, and where no group is, one join by shuffle does all: each
    broadcast costs the driver threads and memory, whatever its size.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    limit = max((total or 0) / HOT_PARTS, small)
    if small and (most or 0) <= limit:
        return rows.join(groups, keys)
    hot = groups.filter(F.col(size) > limit)
    cool = groups.filter(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cool, keys))


def joined_in_parts(rows: DataFrame, others: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows inner-joined with others, of which a key may have several rows on either side.

    Keys that more than a HOT_PARTS-th of rows share, of which there can be HOT_PARTS at most, are broadcast with a number of
    parts, 2 * HOT_PARTS in all: their rows are dealt to these by a hash of the columns ``by``, and the others' rows of
    such a key are copied to each. Both tables are read twice: they should be stored ones.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    limit = (rows.count() // HOT_PARTS) + 1
    hot = F.broadcast(sizes.filter(F.col("size") > limit).select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("parts")))
    dealt = rows.join(hot, keys, "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("parts"))).cast("int")).drop("parts")
    copied = others.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [*keys, "part"]).drop("part")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (..., n) of the greatest n, ``most`` or fewer: whole classes of about equal n, up to the first that doesn't fit."""
    graded = counts.withColumn("grade", F.floor(16 * F.log2("n")))
    edge, taken = None, 0
    for r in sorted(graded.groupBy("grade").agg(F.count("*").alias("rows")).collect(), reverse=True):  # 1,024 grades at most
        if (taken := taken + r.rows) > most:
            break
        edge = r.grade
    return graded.filter(F.lit(False) if edge is None else F.col("grade") >= edge).drop("grade")


def remainder(doc_id, modulus: int):
    """crc32 of a doc_id as text, modulo: the folds of the contracts. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_bytes(text: str = "text"):
    """The UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(labels: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` rows of (doc_id, label), chosen by a hash of doc_id: every size takes the same rule.

    The share kept is most / rows, so the sample's size does not grow with the table.
    """
    n = labels.count()
    if n <= most:
        return labels
    share = int(most / n * (1 << 30))
    return labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Where a public tokenizer's file lies; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
