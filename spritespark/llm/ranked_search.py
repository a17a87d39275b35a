"""Ranked lexical search: the best documents of each query text, found in postings with range-maximum tables.

Documents are read once: each gives its number of terms and the occurrences of the terms that some query holds. These are stored;
their totals (documents, terms, documents a term) turn occurrences into integer impacts. A task then takes the stored rows
in parts of bounded size and indexes each part. The documents of a part are put in an order in which
neighbours have alike lengths and terms. A posting list has its documents' places in that order, their impacts and a sparse table, which answers
where in any run of its postings the greatest impact is.

A query starts with the interval of all documents. An interval's bound is the sum over the query's terms of the greatest impact in
it. The intervals with the greatest bounds are split, many at a time: the document that has the greatest single impact in an
interval is scored whole, and the parts before and after it get bounds of their own. An interval ends when its bound, or with an equal bound its smallest doc_id,
cannot reach the best found so far.

A part's results below what a share of the documents already reaches are dropped where they arise: that share is
searched first, and its last place bounds all others from below. The rest are ranked by an aggregate that keeps the best.

More queries than fit the bounds of a block are searched block by block.

Defined cases: a null or empty text or query has no terms and no result; equal rows of one item_id and text are one query,
different texts of one item_id are ranked each; a null doc_id comes after all others of its score; repeated documents are ranked
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spritespark.llm.common import stored, table, text_bytes
from spritespark.llm.decontamination import _LETTERS, words_of

#: Results of a query.
BEST = 50
#: Queries and bytes of query text in a block: what is broadcast.
ITEMS, ITEM_BYTES = 10_000, 16_000_000
#: Postings and documents of a part.
POSTINGS, DOCUMENTS = 1_000_000, 30_000
#: Documents of the share that is searched first, about.
FIRST = 20_000
#: Bytes of a text whose terms are counted at a time.
BYTES = 1 << 22
#: Intervals that are split at a time.
SPLIT = 128
_NO_ID = (1 << 63) - 1


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def term_counts(text: bytes) -> Counter:
    out, text, at = Counter(), text.translate(_LETTERS), 0
    while at < len(text):
        cut = text.find(b" ", at + BYTES) if len(text) - at > BYTES else -1
        out.update((text[at:cut] if cut >= 0 else text[at:]).split())
        at = cut if cut >= 0 else len(text)
    return out


class Part:
    """Postings of some documents: doc_ids, and by term the places of its documents, rising, with their impacts."""

    def __init__(self, doc_ids: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]]):
        """doc_ids by place; postings: term -> (places, impacts)."""
        self.doc_ids, self.n = doc_ids, len(doc_ids)
        self.start, self.places, self.impacts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        at, longest = 0, 1
        for term, (places, _) in postings.items():
            self.start[term] = (at, at + len(places))
            at += len(places)
            longest = max(longest, len(places))
        if postings:
            self.places, self.impacts = (np.concatenate(x) for x in zip(*postings.values(), strict=True))
        self.best = self._table(self.impacts, longest)
        self.least = self._table(-doc_ids.astype(np.int64), max(1, self.n))
        self.log = np.zeros(max(longest, self.n) + 2, np.int32)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1

    @staticmethod
    def _table(values: np.ndarray, longest: int) -> np.ndarray:
        """Row j: where the greatest of the 2**j values from a place on is, the first of equals. All lists lie in one row; no
        question reaches beyond its list."""
        rows = [np.arange(len(values), dtype=np.int32)]
        while 1 << len(rows) <= longest:
            last, step = rows[-1], 1 << (len(rows) - 1)
            row = last.copy()
            a, b = last[: len(last) - step], last[step:]
            row[: len(a)] = np.where(values[b] > values[a], b, a)
            rows.append(row)
        return np.stack(rows) if len(values) else np.zeros((len(rows), 0), np.int32)

    def _where(self, rows: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the greatest of values[lo:hi] is, for ranges that aren't empty."""
        level = self.log[hi - lo]
        a, b = rows[level, lo], rows[level, hi - (1 << level)]
        return np.where(values[b] > values[a], b, a)

    def search(self, terms: list[int], most: int, floor: int = 1) -> tuple[list[tuple[int, int]], int]:
        """The best (score, doc_id) of at least ``floor``, in order, and how many documents were scored."""
        terms = [t for t in terms if t in self.start]
        if not terms:
            return [], 0
        starts = np.array([self.start[t][0] for t in terms])
        rank = np.zeros((len(terms), self.n + 1), np.int32)  # postings of a term before a place
        for i, t in enumerate(terms):
            a, b = self.start[t]
            rank[i, self.places[a:b] + 1] = 1
        np.cumsum(rank, axis=1, out=rank)
        rank += starts[:, None]

        def bounded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
            """Intervals that have postings: from, to, bound, the place to split at, the smallest doc_id."""
            lo, hi = rank[:, a], rank[:, b]
            some = hi > lo
            at = np.zeros(lo.shape, np.int32)
            at[some] = self._where(self.best, self.impacts, lo[some], hi[some])
            greatest = np.where(some, self.impacts[at], 0)
            split = self.places[at[greatest.argmax(0), np.arange(len(a))]]
            bound = greatest.sum(0)
            return (x[bound >= floor] for x in (a, b, bound, split))

        found: list[tuple[int, int]] = []  # (-score, doc_id), the best so far, in order
        a, b, bound, split = bounded(np.array([0]), np.array([self.n]))
        scored = 0
        while len(a):
            if len(found) == most:
                last, last_id = -found[-1][0], found[-1][1]
                open_ = bound > last
                ties = np.flatnonzero(bound == last)
                if len(ties):
                    open_[ties] = -(-self.doc_ids[self._where(self.least, -self.doc_ids, a[ties], b[ties])]) < last_id
                a, b, bound, split = a[open_], b[open_], bound[open_], split[open_]
                if not len(a):
                    break
            if len(a) > SPLIT:
                chosen = np.argpartition(-bound, SPLIT)[:SPLIT]
                rest = np.ones(len(a), bool)
                rest[chosen] = False
            else:
                chosen, rest = slice(None), np.zeros(len(a), bool)
            left, right, middle = a[chosen], b[chosen], split[chosen]
            own = rank[:, middle + 1] > rank[:, middle]
            score = np.where(own, self.impacts[np.where(own, rank[:, middle], 0)], 0).sum(0)
            scored += len(score)
            good = score >= floor
            if len(found) == most:
                good &= score >= -found[-1][0]
            if good.any():
                found = sorted([*found, *zip((-score[good]).tolist(), self.doc_ids[middle[good]].tolist(), strict=True)])[:most]
            below, above = left < middle, middle + 1 < right
            new = bounded(np.r_[left[below], middle[above] + 1], np.r_[middle[below], right[above]])
            a, b, bound, split = (np.r_[old[rest], x] for old, x in zip((a, b, bound, split), new, strict=True))
        return [(-s, d) for s, d in found], scored


class _Parts:
    """Cuts stored rows (doc_id, size, terms, tfs) into parts of bounded size."""

    def __init__(self, weights: np.ndarray, n_documents: int, n_terms: int):
        self.weights, self.n_documents, self.n_terms = weights, n_documents, n_terms
        self.rows: list[pa.RecordBatch] = []
        self.size = self.postings = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[Part]:
        ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        begin = 0
        while begin < batch.num_rows:
            taken = int(ends[begin - 1]) if begin else 0
            upto = min(batch.num_rows, begin + DOCUMENTS - self.size, max(begin + (not self.size), int(np.searchsorted(ends, taken + POSTINGS - self.postings, "right"))))
            if upto > begin:
                self.rows.append(batch.slice(begin, upto - begin))
                self.size, self.postings = self.size + upto - begin, self.postings + int(ends[upto - 1]) - taken
                begin = upto
            if begin < batch.num_rows:
                yield self.close()

    def close(self) -> Part | None:
        if not self.size:
            return None
        t = pa.Table.from_batches(self.rows).combine_chunks()
        self.rows, self.size, self.postings = [], 0, 0
        doc_ids, sizes = t.column("doc_id").fill_null(_NO_ID).to_numpy(), t.column("size").to_numpy()
        terms, tfs = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        held = np.diff(terms.offsets.to_numpy())
        terms, tfs = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        doc = np.repeat(np.arange(len(doc_ids)), held)
        m = np.array([50 + 50 * int(n) * self.n_documents // self.n_terms for n in sizes], np.int64)
        impacts = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc]))
        # neighbours are alike: by their most frequent one of the part's commonest terms, then by length
        common = np.argsort(-np.bincount(terms, minlength=len(self.weights)), kind="stable")[:32]
        position = np.full(len(self.weights), 32)
        position[common] = np.arange(len(common))
        first = np.full(len(doc_ids), 32)
        order = np.lexsort((position[terms], -tfs, doc))
        order = order[position[terms[order]] < 32]
        seen, at = np.unique(doc[order], return_index=True)
        first[seen] = position[terms[order[at]]]
        place = np.empty(len(doc_ids), np.int64)
        arrangement = np.lexsort((sizes, first))
        place[arrangement] = np.arange(len(doc_ids))
        order = np.lexsort((place[doc], terms))
        terms, places, impacts = terms[order], place[doc[order]].astype(np.int32), impacts[order]
        kinds, starts = np.unique(terms, return_index=True)
        ends = [*starts[1:].tolist(), len(terms)][: len(kinds)]
        return Part(doc_ids[arrangement], {t: (places[a:b], impacts[a:b]) for t, a, b in zip(kinds.tolist(), starts.tolist(), ends, strict=True)})


def _blocks(queries: DataFrame, most: int, most_bytes: int) -> Iterator[tuple[list[tuple[int, int, list[bytes]]], list[bytes]]]:
    """Queries (number, item_id, terms) and their terms, block by block; a block is bounded in rows and bytes."""
    own = stored(queries.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).distinct(), "queries")
    total = own.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    parts = max(-(-total.n // most), -(-(total.bytes or 0) // most_bytes))
    for k in range(parts):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        items = [(i, r.item_id, sorted(set(words_of(bytes(r.text))))) for i, r in enumerate(rows)]
        yield items, sorted({w for _, _, words in items for w in words})


def ranked(documents: DataFrame, queries: DataFrame, best: int = BEST, most: int = ITEMS, most_bytes: int = ITEM_BYTES, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every row of queries (item_id, text)."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items, words in _blocks(queries, most, most_bytes):
        shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                ids, sizes, terms, tfs = [], [], [], []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    counts = term_counts(t.as_py())
                    if counts:
                        held = [(k, n) for w, n in counts.items() if (k := known.get(w)) is not None]
                        ids.append(i)
                        sizes.append(counts.total())
                        terms.append([k for k, _ in held])
                        tfs.append([n for _, n in held])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "size", "terms", "tfs"])

        rows = stored(texts.mapInArrow(read, "doc_id long, size long, terms array<int>, tfs array<long>"), "terms_of_documents")
        totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("terms")).first()
        weights = np.zeros(len(words), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of this block's queries
            weights[r.term] = weight(totals.n, r["count"])
        asked = spark.sparkContext.broadcast((items, words, weights, totals.n, totals.terms))

        def search(batches: Iterator[pa.RecordBatch], floors: dict[int, int], asked=asked) -> Iterator[pa.RecordBatch]:
            items, words, weights, n, n_terms = asked.value
            number = {w: i for i, w in enumerate(words)}
            terms = [[number[w] for w in own] for _, _, own in items]
            parts = _Parts(weights, n, n_terms)

            def results(part: Part) -> pa.RecordBatch:
                found = [(i, item, d if d != _NO_ID else None, s) for i, item, _ in items for s, d in part.search(terms[i], best, floors.get(i, 1))[0]]
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * 4, [pa.int64()] * 4, strict=True)], names=["query", "item_id", "doc_id", "score"])

            for b in batches:
                for part in parts.add(b):
                    yield results(part)
            if part := parts.close():
                yield results(part)

        schema = "query long, item_id long, doc_id long, score long"
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

        def best_of(found: DataFrame, order=order) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)

        share = min(1.0, first / max(1, totals.n))
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 30)) < int(share * (1 << 30)))
        reached = best_of(part.mapInArrow(lambda b, search=search: search(b, {}), schema)).filter(F.col("rank") == best).select("query", "score").collect()  # a row a query
        floors = spark.sparkContext.broadcast({r.query: r.score for r in reached})
        found = rows.mapInArrow(lambda b, search=search, floors=floors: search(b, floors.value), schema)
        out = out.unionByName(best_of(found).select("item_id", "rank", "doc_id", "score"))
    return out


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
