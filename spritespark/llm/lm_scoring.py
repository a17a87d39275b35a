"""LM scoring: a Brown class-based bigram model, P(w | before) = P(class(w) | class(before)) * P(w | class(w)).

Every word of the training texts has a class by exchange, the move that raises the likelihood of the class bigrams most:

1. The SEEDS most frequent words move in turn, one at a time, until no move gains (bigrams of these words, the driver).
2. The HEAD most frequent words move at once, each against the seeds' classes: as their counts are small, the gain of a
   move is linear in a word's counts of neighbours by class, so that Spark sums it by word.
3. All rarer words move at once in the same way, against the classes of their neighbours among the head.

Class bigrams are then counted over all training texts and all words, smoothed with the class frequencies; within a
class each word has its count plus one. One unknown word belongs to the class that most words of a single occurrence
have, so that the model is a distribution over the same words as the plain add-one unigram (base_score). The end of a
text is a class by itself, which also stands before the first word.

All counts are of all training texts. Words are known by a 64-bit hash. The most frequent HEAD words (a size bounded by
a parameter) are broadcast; the others of a text meet their classes and counts in a join by word, no word of which can
hold more than a HEAD-th of the tokens, and then each other in a shuffle by text.

Defined cases: a null text counts as empty; an empty text is its end token alone; a null doc_id is not held out and
not learnt from; repeated rows are scored each; without training texts N and V are 0; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import discard, most_frequent, remainder, stored, table, text_bytes
from spritespark.llm.jaccard import _batch

SEEDS = 1000
CLASSES = 60
HEAD = 200_000
#: Stand for rarer words and for the end among the places of head words.
RARE, END = -1, -2
_KEPT = 300_000


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _Words(dict):
    """Word to a place in arrays of its properties; places above ``first`` are forgotten as a whole when many."""

    def __init__(self, keys: np.ndarray, properties: dict[str, np.ndarray], other):
        """keys: hashes of the words that places 0.. stand for; other(word): a new word's properties."""
        self.known, self.first, self.other = dict(zip(keys.tolist(), range(len(keys)), strict=True)), len(keys), other
        self.properties = {k: np.concatenate([v, np.zeros(_KEPT, v.dtype)]) for k, v in properties.items()}
        self.next = self.first

    def __missing__(self, word: bytes) -> int:
        h = _hash(word)
        at = self.known.get(h)
        if at is None:
            if self.next >= self.first + _KEPT:
                raise OverflowError
            at, self.next = self.next, self.next + 1
            for k, v in self.other(word, h).items():
                self.properties[k][at] = v
        self[word] = at
        return at

    def places(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.clear()
            self.next = self.first
            if len(set(words)) > _KEPT:  # one text with more new words than are kept at all: make room for it
                more = len(set(words))
                self.properties = {k: np.concatenate([v[: self.first], np.zeros(more + _KEPT, v.dtype)]) for k, v in self.properties.items()}
                return np.fromiter(map(self._unbounded, words), np.int64, len(words))
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def _unbounded(self, word: bytes) -> int:
        at = self.get(word)
        if at is None:
            h = _hash(word)
            at = self.known.get(h)
            if at is None:
                at, self.next = self.next, self.next + 1
                for k, v in self.other(word, h).items():
                    self.properties[k][at] = v
            self[word] = at
        return at


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): hash and count of every word."""
    schema = "key long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return _batch(schema, [[_hash(w) for w in sums], list(sums.values())])

        for b in batches:
            for t in b.column("text").to_pylist():
                sums.update(t.lower().split())
                if len(sums) > 500_000:
                    yield out()
                    sums.clear()
        yield out()

    return texts.mapInArrow(count, schema).groupBy("key").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, most: int) -> np.ndarray:
    """(key, n) of at most ``most`` words, the most frequent first, then by key; a class of counts that doesn't fit ends it."""
    out = most_frequent(counts, most).select("key", "n").toPandas().to_numpy(np.int64)
    return out[np.lexsort((out[:, 0], -out[:, 1]))]


def encoded(documents: DataFrame, head: np.ndarray) -> DataFrame:
    """(row, doc_id, held_out, learn, ids, keys): every text as places of head words (4 bytes each), RARE for others, whose
    hashes follow in keys. Stored, so that texts are split once more only, and rows keep their number."""
    schema = "row long, doc_id long, held_out boolean, learn boolean, ids binary, keys binary"
    shared = documents.sparkSession.sparkContext.broadcast(head)  # HEAD words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        words = _Words(shared.value, {"key": shared.value}, lambda w, h: {"key": h})
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            ids, keys = [], []
            for t in b.column("text").to_pylist():
                at = words.places(t.lower().split())
                rare = at >= size
                keys.append(words.properties["key"][at[rare]].tobytes())
                at[rare] = RARE
                ids.append(at.astype("<i4").tobytes())
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(b.column(c) for c in ("doc_id", "held_out", "learn")), pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], names=[c.split()[0] for c in schema.split(", ")])

    return stored(documents.select("doc_id", "held_out", "learn", "text").mapInArrow(encode, schema), "encoded", "zstd")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """The places of a batch's texts, END before, between and after them."""
    end = np.array([END], "<i4").tobytes()
    return np.frombuffer(end + b"".join(chain.from_iterable((x, end) for x in batch.column("ids").to_pylist())), "<i4")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8")


def _lookup(values: np.ndarray, rare, end) -> np.ndarray:
    """An array that places, RARE and END index."""
    return np.r_[values, end, rare]


def symbol_bigrams(texts: DataFrame, seeds: int) -> np.ndarray:
    """Counts of neighbours among the first ``seeds`` words, all other words as one, and, last, the end. texts: encoded."""
    size, schema = seeds + 2, "row int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * size, np.int64)
        for b in _pieces(batches):
            ids = _ids(b).astype(np.int64)
            s = np.where(ids == END, seeds + 1, np.where((ids == RARE) | (ids >= seeds), seeds, ids))
            sums += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        sums = sums.reshape(size, size)
        rows = np.flatnonzero(sums.any(1)).tolist()
        yield _batch(schema, [rows, [sums[i].astype("<i8").tobytes() for i in rows]])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                sums += np.frombuffer(x, "<i8")
        yield _batch(schema, [[key[0].as_py()], [sums.astype("<i8").tobytes()]])

    out = np.zeros((size, size), np.int64)
    for r in texts.select("ids").mapInArrow(count, schema).groupBy("row").applyInArrow(add, schema).collect():  # size * size numbers, whatever the input
        out[r.row] = np.frombuffer(r.counts, "<i8")
    return out


def exchange(bigrams: np.ndarray, words: int, classes: int, rounds: int = 4) -> np.ndarray:
    """The class of every symbol: the first ``words`` are dealt to 0..classes - 1, each other one has its own after them."""
    n = len(bigrams)
    classes = min(classes, max(1, words))
    by_count = np.argsort(-(bigrams.sum(0) + bigrams.sum(1))[:words], kind="stable")
    own = np.r_[np.zeros(words, np.int64), classes + np.arange(n - words)]
    own[by_count] = np.arange(words) % classes
    size = classes + n - words
    c = np.zeros((size, size))
    np.add.at(c, (own[:, None], own[None, :]), bigrams)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)
    everyone = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in by_count:
            k, s = own[w], float(bigrams[w, w])
            left, right = bigrams[:, w].astype(float), bigrams[w].astype(float)
            left[w] = right[w] = 0
            a, b = np.bincount(own, left, size), np.bincount(own, right, size)
            c[:, k] -= a
            c[k] -= b
            c[k, k] -= s
            cols, rows = c[:, :classes], c[:classes]
            gain = (f(cols + a[:, None]) - f(cols)).sum(0) + (f(rows + b) - f(rows)).sum(1)
            d = c[everyone, everyone]
            gain += f(d + a[:classes] + b[:classes] + s) - f(d + a[:classes]) - f(d + b[:classes]) + f(d)
            # the word's neighbours are in all sums, wherever it goes
            ins, outs, i, o = cols.sum(0) + b[:classes], rows.sum(1) + a[:classes], a.sum() + s, b.sum() + s
            gain -= f(ins + i) - f(ins) + f(outs + o) - f(outs)
            best = int(gain.argmax())
            if gain[best] <= gain[k] + 1e-9:
                best = int(k)
            moved += best != k
            own[w] = best
            c[:, best] += a
            c[best] += b
            c[best, best] += s
        if not moved:
            break
    return own


def gains(c: np.ndarray, classes: int) -> np.ndarray:
    """By neighbour's class (before a word, then after it) and new class: what each such neighbour adds to the gain of
    moving a word of few tokens there. c: class bigrams, whose first ``classes`` are those a word can have."""
    c = c + 0.1
    return np.concatenate([np.log(c[:, :classes]) - np.log(c.sum(0)[:classes]), (np.log(c[:classes]) - np.log(c.sum(1)[:classes, None])).T])


def best_moves(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """contexts (key, at, n): neighbours by row of the table of gains -> (key, class): the class of the greatest gain."""
    shared = contexts.sparkSession.sparkContext.broadcast(table)  # classes squared
    schema = "key long, class int"

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rest = None, np.zeros(table.shape[1])  # the last key, whose neighbours may go on
        for b in batches:
            for first in range(0, b.num_rows, 1 << 16):
                part = b.slice(first, 1 << 16)
                key, at, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "at", "n"))
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sums = np.add.reduceat(shared.value[at] * n[:, None], starts)
                own = key[starts]
                if kept is not None and own[0] == kept:
                    sums[0] += rest
                elif kept is not None:
                    yield _batch(schema, [[kept], [int(rest.argmax())]])
                kept, rest = int(own[-1]), sums[-1]
                yield _batch(schema, [own[:-1], sums[:-1].argmax(1).astype(np.int32)])
        if kept is not None:
            yield _batch(schema, [[kept], [int(rest.argmax())]])

    return contexts.select("key", "at", "n").repartition("key").sortWithinPartitions("key").mapInArrow(move, schema)


def head_classes(texts: DataFrame, head: int, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class of every head word: the seeds' own (they come first), the others' by their neighbours among the seeds."""
    seeds, classes = len(own) - 2, int(own[-1]) - 1  # then all other words, then the end
    out = np.r_[own[:seeds], np.zeros(head - seeds, np.int64)]
    if seeds == head:
        return out
    size = classes + 2
    c = np.zeros((size, size))
    np.add.at(c, (own[:, None], own[None, :]), bigrams)
    schema = "key long, at int, n long"
    symbols = _lookup(np.r_[own[:seeds], np.full(head - seeds, classes)], classes, classes + 1)
    shared = texts.sparkSession.sparkContext.broadcast(symbols)  # HEAD numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            for i in range(0, len(code), 1 << 16):
                part = code[i : i + (1 << 16)]
                yield _batch(schema, [part // (2 * size), (part % (2 * size)).astype(np.int32), n[i : i + (1 << 16)]])

        for b in _pieces(batches):
            ids = _ids(b).astype(np.int64)
            s = shared.value[ids]
            i = np.flatnonzero(ids >= seeds)
            codes += [ids[i] * (2 * size) + s[i - 1], ids[i] * (2 * size) + size + s[i + 1]]
            held += 2 * len(i)
            if held > 4_000_000:
                yield from out()
                codes, held = [], 0
        if held:
            yield from out()

    contexts = texts.select("ids").mapInArrow(count, schema)
    for r in best_moves(contexts, gains(c, classes)).collect():  # at most HEAD rows
        out[r.key] = r["class"]
    return out


def neighbours(texts: DataFrame, kinds: np.ndarray, classes: int) -> DataFrame:
    """(key, before, after, next, n): for every token of a word that is not in the head, the classes of its neighbours, -1
    for one of these words, whose hash is ``next`` where it follows. And (null, class, class, null, n): bigrams of the others."""
    schema = "key long, before int, after int, next long, n long"
    shared = texts.sparkSession.sparkContext.broadcast(_lookup(kinds, -1, classes))  # HEAD numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = classes + 1
        sums = np.zeros(size * size, np.int64)
        for b in _pieces(batches):
            s, keys = shared.value[_ids(b)].astype(np.int64), _keys(b)
            both = (s[:-1] >= 0) & (s[1:] >= 0)
            sums += np.bincount(s[:-1][both] * size + s[1:][both], minlength=size * size)
            i = np.flatnonzero(s < 0)
            after = s[i + 1]
            yield _batch(schema, [keys, s[i - 1].astype(np.int32), after.astype(np.int32), pa.array(np.r_[keys[1:], np.zeros(min(1, len(keys)), np.int64)], mask=after >= 0), np.ones(len(i), np.int64)])
        some = np.flatnonzero(sums)
        yield _batch(schema, [[None] * len(some), (some // size).astype(np.int32), (some % size).astype(np.int32), [None] * len(some), sums[some]])

    return texts.select("ids", "keys").mapInArrow(find, schema)


class ClassModel:
    """head, kinds, counts: the head words' hashes, classes and counts; rare: table (key, n, class) of all other
    words; tokens and words by class; step: log10 transitions, the end being the last class; unknown: the class of the unknown word."""

    def __init__(self, head: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rare: DataFrame, tokens: np.ndarray, words: np.ndarray, unknown: int, bigrams: np.ndarray, smoothing: float):
        self.head, self.kinds, self.counts, self.rare, self.unknown = head, kinds, counts, rare, unknown
        room = tokens + words + (np.arange(len(tokens)) == unknown)
        self.share = np.log10(np.maximum(room, 1))
        prior = np.where(np.r_[room > 0, True], bigrams.sum(0) + 1.0, 0.0)
        prior /= prior.sum()
        with np.errstate(divide="ignore"):
            self.step = np.log10((bigrams + smoothing * prior) / (bigrams.sum(1, keepdims=True) + smoothing))


def train_classes(texts: DataFrame, top: np.ndarray, counts: DataFrame, seeds: int = SEEDS, classes: int = CLASSES, smoothing: float = 20.0) -> ClassModel:
    """texts: encoded ones to learn from, by the head words top (key, n); counts: their word_counts, stored."""
    bigrams = symbol_bigrams(texts, min(seeds, len(top)))
    own = exchange(bigrams, len(bigrams) - 2, classes)
    k = int(own[-1]) - 1
    kinds = head_classes(texts, len(top), own, bigrams)
    found = stored(neighbours(texts, kinds, k), "neighbours", "zstd")
    c = np.zeros((k + 1, k + 1))
    for r in found.filter("key IS NULL").groupBy("before", "after").agg(F.sum("n").alias("n")).collect():  # classes squared
        c[r.before, r.after] += r.n
    of_rare = found.filter("key IS NOT NULL")
    contexts = of_rare.select("key", F.explode(F.array("before", F.expr(f"CASE WHEN after >= 0 THEN after + {k + 1} ELSE -1 END"), F.lit(-2))).alias("at"), F.lit(1).alias("n")).filter("at <> -1")
    # a word without a neighbour in the head has no gain anywhere: a row of zeros keeps it
    moves = best_moves(contexts.withColumn("at", F.when(F.col("at") == -2, 2 * (k + 1)).otherwise(F.col("at")).cast("int")), np.concatenate([gains(c, k), np.zeros((1, k))]))
    rare = stored(moves.join(counts, "key").select("key", "n", "class"), "classes")
    named = of_rare.join(rare.select("key", "class"), "key")
    step = named.select(F.explode(F.array(F.struct(F.col("before").alias("i"), F.col("class").alias("j")), F.struct(F.col("class").alias("i"), F.col("after").alias("j")))).alias("x")).filter("x.i >= 0 AND x.j >= 0").groupBy("x.i", "x.j").count()
    pairs = of_rare.filter("next IS NOT NULL").select("key", "next").join(rare.select("key", F.col("class").alias("i")), "key").join(rare.select(F.col("key").alias("next"), F.col("class").alias("j")), "next").groupBy("i", "j").count()
    for r in step.union(pairs).collect():  # classes squared, twice
        c[r[0], r[1]] += r[2]
    discard(found)
    tokens, words = np.bincount(kinds, top[:, 1], k).astype(float), np.bincount(kinds, minlength=k).astype(float)
    single = np.zeros(k)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.expr("int(n = 1)")).alias("once")).collect():  # a row a class
        tokens[r["class"]], words[r["class"]], single[r["class"]] = tokens[r["class"]] + r.n, words[r["class"]] + r.v, r.once
    return ClassModel(top[:, 0], kinds, top[:, 1], rare, tokens, words, int(single.argmax()), c, smoothing)


def score_texts(documents: DataFrame, seeds: int = SEEDS, classes: int = CLASSES, head: int = HEAD, smoothing: float = 20.0) -> DataFrame:
    """documents: doc_id, text (binary), held_out, learn (whether to learn from it). See class_scores for the result."""
    training = documents.filter("learn").select("text")
    counts = stored(word_counts(training), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = _top(counts, head)
    texts = encoded(documents, top[:, 0])
    ends = texts.filter("learn").count()
    tokens, distinct = totals.n + ends, totals.v + (ends > 0)
    model = train_classes(texts.filter("learn"), top, counts, seeds, classes, smoothing)
    k = len(model.share)
    logs = np.log10(model.counts + 1.0)
    luts = _lookup(model.kinds, -1, k), _lookup(logs, 0.0, np.log10(ends + 1)), _lookup(logs - model.share[model.kinds], 0.0, 0.0)
    shared = documents.sparkSession.sparkContext.broadcast((*luts, model.step, model.share))  # HEAD words and classes squared
    floor = float(np.log10(tokens + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, logs, emissions, step, _ = shared.value
        step = np.c_[np.r_[step, np.zeros((1, k + 1))], np.zeros(k + 2)]  # -1: rare words' steps are added by their own rows
        for b in _pieces(batches):
            ids = _ids(b)
            ends_at = np.flatnonzero(ids == END)
            s = kinds[ids]
            parts = ((ids[1:] != RARE).astype(np.int64), logs[ids[1:]], emissions[ids[1:]] + step[s[:-1], s[1:]])
            known, log, model_ = (np.add.reduceat(x, ends_at[:-1]) for x in parts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "held_out")), *(pa.array(x) for x in (np.diff(ends_at), known - (ends == 0), log, model_))], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            ids = _ids(b)
            s, rows = shared.value[0][ids], np.repeat(b.column("row").to_numpy(), np.diff(np.flatnonzero(ids == END)))
            i = np.flatnonzero(ids == RARE)
            yield _batch("row long, key long, place long, before int, after int", [rows[i - 1], _keys(b), i, s[i - 1].astype(np.int32), s[i + 1].astype(np.int32)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, step, share = shared.value
        step = np.c_[np.r_[step, np.zeros((1, k + 1))], np.zeros(k + 2)]  # -1: the neighbour is counted by its own row
        last = None  # row and class of an entry whose follower is still to come
        for b in batches:
            if not b.num_rows:
                continue
            row, place, before, after, kind, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "place", "before", "after", "class", "n"))
            score = np.log10(n + 1.0) - share[kind] + step[before, kind] + step[kind, after]
            if last is not None and last[0] == row[0] and before[0] < 0:
                score[0] += step[last[1], kind[0]]
            follows = (row[1:] == row[:-1]) & (before[1:] < 0)
            score[1:] += np.where(follows, step[kind[:-1], kind[1:]], 0.0)
            last = (row[-1], kind[-1])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            sums = (np.add.reduceat(x, starts) for x in (np.log10(n + 1.0), score))
            yield pa.RecordBatch.from_arrays([pa.array(row[starts]), *(pa.array(x) for x in sums), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts))], names=["row", "logs", "model", "found"])

    rare = texts.select("row", "ids", "keys").mapInArrow(ask, "row long, key long, place long, before int, after int").join(model.rare, "key", "left")
    rare = rare.select("row", "place", "before", "after", F.coalesce("class", F.lit(model.unknown)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    rare = rare.repartition("row").sortWithinPartitions("row", "place").mapInArrow(add, "row long, logs double, model double, found long")
    rare = rare.groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("logs", "model", "found")))
    more = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))
    scored = texts.select("row", "doc_id", "held_out", "ids").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double")
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_found", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (more("logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), more("model").alias("score"),
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: log10 probabilities of every document, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    return score_texts(texts.withColumn("learn", F.expr("NOT held_out AND doc_id IS NOT NULL")))
