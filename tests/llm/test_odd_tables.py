"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import datetime

import pytest
from pyspark.sql import functions as F

from spritespark.llm import registry

WORDS = "the onen erble thesh ation of in was heon reand thli".split()


def text(i, n):
    return " ".join(WORDS[(i * 7 + k * k + k // 3) % len(WORDS)] + ("." if k % 9 == 8 else "") for k in range(n))


def rows():
    out = [(0, "", "en", "s"), (1, None, None, None), (2, text(2, 60), "en", "s"), (3, text(2, 60), "de", "s"), (2, text(2, 60), "en", "s"), (None, text(5, 20), "en", None), (4, "word", "en", "s"), (5, "x " * 60_000, "en", "s"), (6, "é ü " + text(9, 40) + " joe@mail.example.com +1 (499) 555-6503 10.0.0.1", "fr", "s"), (7, "y" * 50_000, "en", "s"), (8, " \x1c \n\t", "en", "s")]
    return out + [(10 + i, text(i, 10 + i % 50), "en", "s") for i in range(60)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    keep = (lambda df: df) if request.param == "odd" else (lambda df: df.limit(0))
    documents = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    for c in ("label", "score", "key", "n", "row", "held_out", "component", "h", "bytes", "base_spans", "all_spans", "sig", "c"):  # names that operators use
        documents = documents.withColumn(c, F.lit("own"))
    keep(documents.withColumn("n_chars", F.length("text").cast("long"))).write.parquet(f"{d}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(70)] + [(3, None, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    keep(labels).write.parquet(f"{d}/labels.parquet")
    keep(spark.createDataFrame([(1, text(2, 30)), (2, None), (3, ""), (None, "x y z")], "item_id long, text string")).write.parquet(f"{d}/benchmark.parquet")
    keep(spark.createDataFrame([(1, "https://u@a.b.example.com:8/x", ""), (2, None, None), (3, "nohost", ""), (1, "http://b.example.com", "")], "page_id long, url string, html string")).write.parquet(f"{d}/pages.parquet")
    at = datetime.datetime(2024, 1, 1)
    keep(spark.createDataFrame([(1, at, 1, "click", 1.0, ""), (2, at, 1, "click", 1.0, ""), (4, at, 1, "view", 1.0, ""), (5, None, 1, None, None, None)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")).write.parquet(f"{d}/events.parquet")
    return request.param, str(d)


EXPECTED = {"op1": 71, "op2": 71, "op3": 4, "op6": 71, "op7": 71, "op8": 70, "op10": 71, "op13": 71}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_operator(spark, folder, name):
    kind, d = folder
    got = registry.queries()[name](spark, d)
    n = len(got.collect())
    if kind == "empty":
        assert n == 0
    elif name.split("_")[0] in EXPECTED:
        assert n == EXPECTED[name.split("_")[0]]
    else:
        assert n > 0


def test_stages(spark, folder):
    import corpus_pipeline

    kind, d = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.collect()
    assert (corpus_pipeline.run(spark, d).count() > 0) == (kind == "odd")


def test_one_row_of_a_repeated_document_stays(spark, folder):
    from spritespark.llm.jaccard import keep_one_of_each

    kind, d = folder
    if kind == "odd":
        kept = keep_one_of_each(spark.read.parquet(f"{d}/documents.parquet"))
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        assert ids.count(2) == 1 and 3 not in ids and ids.count(None) == 1 and {0, 1, 4, 8} <= set(ids)


def test_spans_make_up_every_interval(spark):
    from spritespark.llm.url_filters import spans_of

    rows = [(a, b) for a in range(0, 40, 3) for b in range(a - 1, 41, 5)] + [(0, 3649)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", spans_of(F.col("a"), F.col("b"), 3649).alias("s")).collect()
    for r in got:
        assert sorted(k for x in r.s for k in range(x.node << x.level, (x.node + 1) << x.level)) == list(range(r.a, r.b + 1)) and len(r.s) <= 24
