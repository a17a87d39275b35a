"""Numbers in groups that span many ranges, named kernels."""

from pyspark.sql import functions as F

from spritespark.operators.ranges import numbered
from spritespark.sources.files import parse_kernels


def test_numbers_of_one_large_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4900, 1).otherwise(F.col("id")).alias("k"), ((F.col("id") * 7919) % 5003).alias("o"), (F.col("id") % 5).alias("v"))
    got = {}
    for r in numbered(rows, ["k"], ["o"], F.col("v")).collect():
        got.setdefault(r.k, []).append((r.o, r.number, r.before, r.v))
    for own in got.values():
        total = 0
        for i, (_, number, before, v) in enumerate(sorted(own)):
            assert (number, before) == (i, total)
            total += v


def test_named_kernels(spark):
    text = "# a b\nneg 1 1 0 0 { -1 } auto auto rgb\nedge 3 1 1 0 { -1 0\n 1 } auto auto rgba # x\nbad 2 2 0 0 { 1 2 3 } 1 0 r\nblur 3 1 1 0 { 1 2 1 } 8 -3 ga"
    got = [(r.name, r.w, r.h, r.cx, r.cy, list(r.weights), r.div, r.bias, r.target) for r in parse_kernels(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("place").collect()]
    assert got == [("neg", 1, 1, 0, 0, [-1], 1, 255, "rgb"), ("edge", 3, 1, 1, 0, [-1, 0, 1], 1, 128, "rgba"), ("blur", 3, 1, 1, 0, [1, 2, 1], 8, -3, "ga")]
