"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the sum-of-squares
identity makes the pairwise part linear in the words of a text. Texts are scored where they are read: no shuffle.

Defined cases: a null text counts as empty, an empty text gets the score of its structure features alone; a null
doc_id is never held out and never learnt from; rows that repeat are scored each; without labelled rows of both
classes every score is the labelled rate (0.5 without any); extra columns pass through ``score_quality`` untouched.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import bounded, fresh, remainder, table, text_bytes

WORDS = 1 << 15
BINS = 12
STATS = ("length", "words", "word_length", "upper", "mark", "symbol", "digit", "distinct", "line", "same_line", "same_word", "top")
SIZE = WORDS + BINS * len(STATS)
#: At most about so many labelled rows are learnt from.
SAMPLE = 12_000
THRESHOLD = 0.3
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = b"#$%&*+<=>@\\^_`{|}~!"


class _Slots(dict):
    """Word to feature; forgotten as a whole when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        at = self[word] = zlib.crc32(word) % WORDS
        return at


def _bin(value: float, most: float) -> int:
    return min(BINS - 1, max(0, int(value / most * BINS)))


def features(text: bytes, slots: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one whole text: word counts scaled to length 1, then one bin for each statistic."""
    words = text.lower().split()
    n, m = max(1, len(text)), max(1, len(words))
    at = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
    counts = np.bincount(at, minlength=0) if len(at) else np.zeros(0, np.int64)
    ids = np.flatnonzero(counts)
    values = np.log1p(counts[ids])
    lines = text.split(b"\n")
    kept = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stats = (
        _bin(math.log1p(len(text)), 14), _bin(math.log1p(len(words)), 12), _bin(len(text) / m, 24), _bin((len(text) - kept) / n, 1),
        _bin((len(text) - len(text.translate(None, _PUNCT))) / m, 3), _bin((len(text) - len(text.translate(None, _SYMBOL))) / m, 1.5),
        _bin((len(text) - len(text.translate(None, b"0123456789"))) / n, 0.3), _bin(len(ids) / m, 1), _bin(math.log1p(m / len(lines)), 8),
        _bin(1 - len(set(lines)) / len(lines), 1), _bin(sum(map(operator.eq, words, words[1:])) / m, 0.3),
        _bin((counts.max() if len(at) else 0) / m, 0.5),
    )
    norm = math.sqrt(float(values @ values)) or 1.0
    own = WORDS + BINS * np.arange(len(stats)) + np.array(stats)
    return np.concatenate([ids, own]).astype(np.int32), np.concatenate([values / norm, np.full(len(stats), 0.5)]).astype(np.float32)


class FactorisationMachine:
    """Weights (w0, w, v) and their fit by AdaGrad on the logistic loss."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 4, epochs: int = 6, steps: int = 250, batch: int = 128, rate: float = 0.08, decay: float = 1e-4) -> FactorisationMachine:
        rng = np.random.default_rng(7)
        mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.03, (SIZE, rank)).astype(np.float32)
        w0 = math.log(mean / (1 - mean))
        if len(set(y.tolist())) < 2:
            return cls(w0, w, v * 0)
        gw, gv = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, rank), 1e-2, np.float32)
        for _ in range(max(epochs, -(-steps * batch // len(rows)))):  # few rows: as many steps at least
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                ids, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                sizes = np.array([len(rows[i][0]) for i in part])
                starts, row = np.r_[0, sizes.cumsum()[:-1]], np.repeat(np.arange(len(part)), sizes)
                vx = v[ids] * x[:, None]
                s = np.add.reduceat(vx, starts)
                z = w0 + np.add.reduceat(w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                w0 -= rate * float(g.sum())
                gx = (g[row] * x).astype(np.float32)
                by = np.argsort(ids, kind="stable")
                u, first = np.unique(ids[by], return_index=True)
                dw = np.add.reduceat(gx[by], first) * len(part) ** 0.5 + decay * w[u]
                dv = np.add.reduceat((gx[:, None] * (s[row] - vx))[by], first) * len(part) ** 0.5 + decay * v[u]
                gw[u] += dw * dw
                gv[u] += dv * dv
                w[u] -= rate * dw / np.sqrt(gw[u])
                v[u] -= rate * dv / np.sqrt(gv[u])
        return cls(w0, w, v)


def train_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> FactorisationMachine:
    """Fit on a bounded sample of the given labelled rows; only their features (bounded by SIZE a row) reach the driver."""
    known = bounded(labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().dropDuplicates(["doc_id"]), sample)
    # the sample is bounded by its parameter, and so may be broadcast
    rows = documents.select("doc_id", text_bytes().alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for b in batches:
            got = [features(t, slots) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["doc_id", "label", "ids", "x"])

    got = sorted(rows.mapInArrow(extract, "doc_id long, label int, ids binary, x binary").collect(), key=lambda r: (r.doc_id, r.label, bytes(r.ids)))
    return FactorisationMachine.fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.x, np.float32)) for r in got], np.array([r.label for r in got], np.float64))


def score_quality(documents: DataFrame, model: FactorisationMachine, column: str = "score") -> DataFrame:
    """documents with the score of every whole text in ``column`` (which replaces a column of that name)."""
    shared = documents.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))  # SIZE * (rank + 1) floats, whatever the input
    base = documents.drop(column)
    own_text = fresh(base, "bytes")
    schema = base.withColumn(column, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slots = FactorisationMachine(*shared.value), _Slots()
        for b in batches:
            z = np.array([own.raw(*features(t, slots)) for t in b.column(own_text).to_pylist()], np.float64)
            keep = [i for i, n in enumerate(b.schema.names) if n != own_text]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=[*(b.schema.names[i] for i in keep), column])

    return base.withColumn(own_text, text_bytes()).mapInArrow(score, schema)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's score, learnt from rows whose crc32(doc_id) mod 5 is not 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_quality(documents, labels.filter(remainder("doc_id", 5) != 0))
    scored = score_quality(documents.select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
