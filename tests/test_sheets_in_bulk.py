"""Layouts of many small sheets: rows of whole sheets, not a call for each sheet."""

from pyspark.sql import functions as F

from spritespark.operators import grouped as G
from spritespark.operators.palettes import packed_sheets


def _many(spark, sheets):
    """Sheets of one to seven samples, and one of as many samples as there are sheets, so that it spans batches."""
    few = spark.range(sheets).select(F.col("id").alias("sheet"), F.explode(F.sequence(F.lit(0), (F.col("id") % 7).cast("int"))).alias("item"))
    one = spark.range(sheets).select(F.lit(sheets).cast("long").alias("sheet"), F.col("id").cast("int").alias("item"))
    i = F.col("sheet") * 31 + F.col("item") * 17
    return few.union(one).select("sheet", "item", (4 + i % 29).cast("int").alias("w"), (4 + i % 13).cast("int").alias("h")).repartition(8, "item")


def _wrapped(rows, width):
    out, x, y, band = [], 0, 0, 0
    for r in sorted(rows):
        if x and x + r[1] > width:
            x, y, band = 0, y + band, 0
        out.append((r[0], x, y, r[1], r[2]))
        x, band = x + r[1], max(band, r[2])
    return out


def _by_sheet(rows):
    out = {}
    for s, *r in rows:
        out.setdefault(s, []).append(tuple(r))
    return out


def test_wrapped_layout_of_many_sheets(spark):
    samples = _many(spark, 12_000)
    found = G.wrapped_layout(samples, 40)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = _by_sheet(found.collect())
    assert {s: sorted(r) for s, r in got.items()} == {s: _wrapped(r, 40) for s, r in _by_sheet(samples.collect()).items()}


def test_packed_sheets_of_many_sheets(spark):
    samples = _many(spark, 3_000).filter("sheet < 3000").withColumn("content", F.col("w") * 100 + F.col("h"))
    found = packed_sheets(samples, 1, 2, content="content")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    sizes = {(s, i): (w, h) for s, i, w, h, _ in samples.collect()}
    sheets = _by_sheet((r.sheet, r.item, r.x, r.y, r.w, r.h, r.width, r.height) for r in found.collect())
    assert {(s, r[0]): r[3:5] for s, rows in sheets.items() for r in rows} == sizes
    for rows in sheets.values():
        spots = {r[1:5] for r in rows}
        assert len(spots) == len({r[3:5] for r in rows})
        assert all(x >= 2 and y >= 2 and x + w <= rows[0][5] - 2 and y + h <= rows[0][6] - 2 for x, y, w, h in spots)
        assert all(a == b or a[0] + a[2] < b[0] or b[0] + b[2] < a[0] or a[1] + a[3] < b[1] or b[1] + b[3] < a[1] for a in spots for b in spots)
