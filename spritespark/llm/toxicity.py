"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

The ratios r = log((p + a) / |p|) - log((q + a) / |q|) count in how many labelled texts of either class an n-gram
occurs; a logistic regression over x = r * presence is then fitted. Both learn from bounded samples of the labelled
rows, whose ids are broadcast: texts are never shuffled. Counts are summed by blocks of fixed size, and texts are
scored where they are read.

Defined cases: a null text counts as empty, an empty text scores the intercept; a null doc_id is never held out
and never learnt from; repeated rows are scored each; with one class only, every score is the smoothed rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import bounded, fresh, remainder, table, text_bytes

LENGTHS = (3, 4, 5)
BUCKETS = 1 << 19
BLOCK = 1 << 13
#: So many n-grams of the greatest weight of evidence get a coefficient.
KEPT = 4_000
#: At most about so many labelled rows are counted for the ratios, and of these so many fit the coefficients.
COUNTED, SAMPLE = 200_000, 20_000
THRESHOLD = 0.7
_PRIME = np.uint32(0x01000193)


def ngram_buckets(text: bytes) -> np.ndarray:
    """The bucket of every n-gram of the bytes, A-Z lower-cased, with a space at each end."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    out, h = [], np.full(len(raw), 0x811C9DC5, np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(raw) < n:
            break
        h = (h[: len(raw) - n + 1] ^ raw[n - 1 :]) * _PRIME
        if n in LENGTHS:
            out.append((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class _Present:
    """Distinct buckets of a text in linear time: the last position to write a bucket's stamp stands for it."""

    def __init__(self, size: int):
        self.stamp = np.zeros(size, np.int32)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        own = np.arange(len(at), dtype=np.int32)
        self.stamp[at] = own
        return at[self.stamp[at] == own]


def class_counts(labelled: DataFrame) -> DataFrame:
    """(block, n0, n1, texts0, texts1): the texts of either class with each n-gram. labelled: text (binary), label.

    Each task sums its rows and gives BUCKETS / BLOCK rows of bounded size, which are added by block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts, present = np.zeros((2, BUCKETS), np.int64), [0, 0], _Present(BUCKETS)
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                sums[label][present(ngram_buckets(text))] += 1
                texts[label] += 1
        if sum(texts):
            for at in range(0, BUCKETS, BLOCK):
                if (part := sums[:, at : at + BLOCK]).any() or not at:
                    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in part), pa.array([texts[0] if not at else 0], pa.int64()), pa.array([texts[1] if not at else 0], pa.int64())], names=["block", "n0", "n1", "texts0", "texts1"])

    schema = "block int, n0 binary, n1 binary, texts0 long, texts1 long"

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros((2, BLOCK), np.int64), [0, 0]
        for b in batches:
            for i in (0, 1):
                texts[i] += sum(b.column(f"texts{i}").to_pylist())
                for x in b.column(f"n{i}").to_pylist():
                    sums[i] += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums), *(pa.array([x], pa.int64()) for x in texts)], names=["block", "n0", "n1", "texts0", "texts1"])

    return labelled.select("text", "label").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema)


class NaiveBayesLinear:
    """slot: bucket -> 0 or 1 + the place of its coefficient; weight already holds ratio times coefficient."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, bias: float):
        self.slot, self.weight, self.bias = slot, weight, bias

    def raw(self, text: bytes) -> float:
        at = self.slot[ngram_buckets(text)]
        return float(self.bias + self.weight[np.unique(at[at > 0])].sum())


def _fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, decay: float = 3e-3, steps: int = 250, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Coefficients over x = ratio * presence, by full-batch Adam on the logistic loss."""
    ids, row = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias = np.zeros(len(ratio)), prior
    m = v = np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, (w * ratio)[ids], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        d = np.r_[np.bincount(ids, g[row], minlength=len(ratio)) * ratio + decay * w, g.sum()]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train_toxicity(documents: DataFrame, labels: DataFrame, kept: int = KEPT, counted: int = COUNTED, sample: int = SAMPLE, label: str = "toxic") -> NaiveBayesLinear:
    """labels: those to learn from; at most about ``counted`` give the ratios, ``sample`` of them the coefficients."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).dropna().dropDuplicates(["doc_id"])
    known = bounded(known, counted)
    # the samples are bounded by their parameters, and so may be broadcast
    texts = documents.select("doc_id", text_bytes().alias("text")).join(F.broadcast(known), "doc_id")
    n, total = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in class_counts(texts).collect():  # BUCKETS / BLOCK rows of fixed size
        for i in (0, 1):
            n[i, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r[f"n{i}"], np.int64)
            total[i] += r[f"texts{i}"]
    slot = np.zeros(BUCKETS, np.int32)
    prior = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    if not total.all():
        return NaiveBayesLinear(slot, np.zeros(1), prior)
    ratio = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    evidence = np.abs(ratio) * np.sqrt(n.sum(0)) * (n.sum(0) > 4)
    best = np.argsort(-evidence, kind="stable")[:kept]
    best = best[evidence[best] > 0]
    slot[best] = np.arange(1, len(best) + 1)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(slot[ngram_buckets(t)]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x[x > 0].astype(np.int32).tobytes() for x in got], pa.binary())], names=["doc_id", "label", "ids"])

    few = documents.select("doc_id", text_bytes().alias("text")).join(F.broadcast(bounded(known, sample)), "doc_id").select("doc_id", "label", "text")
    got = sorted(few.mapInArrow(extract, "doc_id long, label int, ids binary").collect(), key=lambda r: (r.doc_id, r.label, bytes(r.ids)))
    own = np.r_[0.0, ratio[best]]
    w, bias = _fit([np.frombuffer(r.ids, np.int32) for r in got], np.array([r.label for r in got], np.float64), own, prior)
    return NaiveBayesLinear(slot, w * own, bias)


def score_toxicity(documents: DataFrame, model: NaiveBayesLinear, column: str = "score") -> DataFrame:
    """documents with the score of every whole text in ``column`` (which replaces a column of that name)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias))  # BUCKETS + kept numbers, whatever the input
    base = documents.drop(column)
    own_text = fresh(base, "bytes")
    schema = base.withColumn(column, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NaiveBayesLinear(*shared.value)
        for b in batches:
            z = np.array([own.raw(t) for t in b.column(own_text).to_pylist()], np.float64)
            keep = [i for i, n in enumerate(b.schema.names) if n != own_text]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*(b.schema.names[i] for i in keep), column])

    return base.withColumn(own_text, text_bytes()).mapInArrow(score, schema)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's score, learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(documents, labels.filter(remainder("doc_id", 3) != 1))
    scored = score_toxicity(documents.select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
