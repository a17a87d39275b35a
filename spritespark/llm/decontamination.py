"""Benchmark decontamination: every passage of every text queries a BM25 inverted index of test items with block-max WAND.

Items are indexed by classes of length, each up to twice as long as the one before. A passage is a window of words, twice as long as
the class allows and half overlapping the next, so that an item lies whole in one of them, and no item's passages depend on
another item's length. Scores are BM25 with an item's self-score as unit; all items at or above THRESHOLD are
retrieved, then verified: the item's question (all but its last sentence) and answer (its last sentence; for one
sentence, its last third) must each share enough word pairs with the passage.

Before the index is walked, all passages of a text are bounded at once, from block maxima: terms so common that they
can't give any item more than half of the threshold together are set aside, and the others' greatest impacts in each
block of items are summed by passage. Only passages of which some block can reach the threshold go through WAND.

An index holds about ITEMS items and ITEM_BYTES at most and is broadcast; more items are indexed in blocks, each of which reads the texts.
Term and item statistics are those of all items, so that blocks do not change a score.

Defined cases: a null or empty text or item has no match; a null doc_id is kept as null; repeated rows match each;
empty tables give no rows; extra columns pass through ``drop_contaminated`` and are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import stored, table, text_bytes

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION, ANSWER = 0.5, 0.5
ITEMS, ITEM_BYTES = 20_000, 32_000_000
#: Words of the shortest class of items.
SHORT = 8
BLOCK = 64
#: Items in a block of the first bound.
COARSE = 2
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def pairs_of(words: list) -> set:
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else set(words)


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words_of(s.encode()))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    own = parts[0] if parts else []
    cut = max(1, len(own) * 2 // 3)
    return own[:cut], own[cut:] or own


class BlockMaxIndex:
    """Postings by term: items in order with their impacts (of a self-score of 1), in blocks with their greatest impact."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, df: dict[bytes, int] | None = None, n: int = 0, mean: float = 1.0, longest: int | None = None):
        """df: the number of items by word, n: of all items, mean: their words; without df, those of these items. longest: words of
        an item that passages must hold whole, by default those of the longest one here."""
        own = [(i, t, words_of(t.encode())) for i, t in sorted(items) if words_of(t.encode())]
        self.threshold = threshold
        self.item_ids = [i for i, _, _ in own]
        self.checks = [tuple(pairs_of(p) for p in question_and_answer(t)) for _, t, _ in own]
        self.singles = [tuple(len(p) == 1 for p in question_and_answer(t)) for _, t, _ in own]
        if df is None:
            df, n = Counter(w for _, _, words in own for w in set(words)), len(own)
            mean = sum(len(w) for _, _, w in own) / max(1, n)
        self.half = max(SHORT, longest or max((len(w) for _, _, w in own), default=1))
        self.terms = {w: k for k, w in enumerate(sorted({w for _, _, words in own for w in words}))}
        idf = {w: float(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))) for w in self.terms}
        postings: list[list] = [[] for _ in self.terms]
        for at, (_, _, words) in enumerate(own):
            impact = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in Counter(words).items()}
            self_score = sum(impact.values())
            for w, x in impact.items():
                postings[self.terms[w]].append((at, x / self_score))
        self.docs = [[d for d, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.blocks = [[(p[min(i + BLOCK, len(p)) - 1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for p in postings]
        self.most = np.array([max(x) for x in self.impacts] + [0.0])
        # the most frequent terms that together give no item half of the threshold: not needed for the first bound
        given: dict[int, float] = defaultdict(float)
        coarse: list[dict[int, float]] = [{} for _ in postings]
        for k in sorted(range(len(postings)), key=lambda k: (-len(postings[k]), k)):
            if all(given[d] + x <= threshold / 2 for d, x in postings[k]):
                for d, x in postings[k]:
                    given[d] += x
            else:
                for d, x in postings[k]:
                    coarse[k][d // COARSE] = max(x, coarse[k].get(d // COARSE, 0.0))
        self.aside = max(given.values(), default=0.0)
        self.coarse_blocks = max(1, -(-len(own) // COARSE))
        self.start = np.r_[0, np.cumsum([len(c) for c in coarse], dtype=np.int64), 0]  # a last, empty one for unknown words
        self.start[-1] = self.start[-2]
        self.coarse = np.array([d for c in coarse for d in c], np.int64)
        self.coarse_impact = np.array([x for c in coarse for x in c.values()], np.float64)

    def promising(self, ids: np.ndarray, half: int) -> list[int]:
        """First words of the passages (two halves each) of which some block of items can reach the threshold.

        ids: term numbers, -1 for unknown words. Long texts go in parts, so that memory stays bounded.
        """
        out, step = [], max(2, 4_000_000 // max(1, self.coarse_blocks))
        halves = -(-len(ids) // half)
        for first in range(0, max(1, halves - 1), step - 1):
            part = ids[first * half : (first + step) * half]
            n = -(-len(part) // half)
            known = np.flatnonzero(part >= 0)
            terms = part[known]
            size = self.start[terms + 1] - self.start[terms]
            at = np.repeat(self.start[terms] - np.r_[0, size.cumsum()[:-1]] if len(size) else size, size) + np.arange(size.sum())
            sums = np.bincount(np.repeat(known // half, size) * self.coarse_blocks + self.coarse[at], self.coarse_impact[at], n * self.coarse_blocks).reshape(n, self.coarse_blocks)
            both = sums[:-1] + sums[1:] if n > 1 else sums
            if both.size:
                out += ((first + np.flatnonzero(both.max(1) >= self.threshold - self.aside - 1e-9)) * half).tolist()
        return out

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(place of item, score) of all items that the distinct terms score at or above the threshold."""
        lists = [[self.docs[k][0], 0, k] for k in terms]  # current item, position, term
        out, end = [], len(self.item_ids)
        need = self.threshold - 1e-9
        while True:
            lists.sort()
            total, pivot = 0.0, -1
            for i, (doc, _, k) in enumerate(lists):
                if doc == end:
                    break
                total += self.most[k]
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
                pivot += 1
            # the block maxima at the pivot's item give a tighter bound
            bound, following = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for _, pos, k in lists[: pivot + 1]:
                b = pos // BLOCK
                blocks = self.blocks[k]
                while b < len(blocks) and blocks[b][0] < doc:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    following = min(following, blocks[b][0] + 1)
            if bound < need:  # no item before the next block's start can reach it
                self._advance(lists, pivot, max(following, doc + 1), end)
            elif lists[0][0] == doc:
                score = sum(self.impacts[k][pos] for d, pos, k in lists[: pivot + 1])
                if score >= need:
                    out.append((doc, score))
                self._advance(lists, pivot, doc + 1, end)
            else:
                self._advance(lists, pivot, doc, end)

    def _advance(self, lists: list, upto: int, target: int, end: int) -> None:
        for entry in lists[: upto + 1]:
            docs, pos = self.docs[entry[2]], entry[1]
            while pos < len(docs) and docs[pos] < target:
                pos += 1 if pos % BLOCK or pos + BLOCK > len(docs) or docs[pos + BLOCK - 1] >= target else BLOCK
            entry[0], entry[1] = (docs[pos] if pos < len(docs) else end), pos

    def matches(self, words: list[bytes]) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question, answer, first word) of the verified items of a text's words, each at its best passage."""
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        half = self.half
        window = 2 * half
        best: dict[int, tuple] = {}
        for start in self.promising(ids, half) if self.item_ids else []:
            part = ids[start : start + window]
            terms = np.unique(part[part >= 0]).tolist()
            found = self.search(terms) if terms else []
            if found:
                own = words[start : start + window]
                pairs, single = pairs_of(own), set(own)
                for at, score in found:
                    q, a = (len(c & (single if one else pairs)) / len(c) for c, one in zip(self.checks[at], self.singles[at], strict=True))
                    if q >= QUESTION and a >= ANSWER and score > best.get(at, (0, 0))[1]:
                        best[at] = (self.item_ids[at], score, q, a, start)
        return [best[at] for at in sorted(best)]


class Indexes:
    """An index for each class of item lengths: 1 to SHORT words, then up to twice as many, and so on."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, df: dict[bytes, int], n: int, mean: float):
        classes: dict[int, list] = defaultdict(list)
        for item in items:
            size = len(words_of(item[1].encode()))
            classes[SHORT << max(0, -(-size // SHORT) - 1).bit_length()].append(item)
        self.parts = [BlockMaxIndex(classes[k], threshold, df, n, mean, k) for k in sorted(classes)]

    def matches(self, text: bytes) -> list[tuple[int, float, float, float, int]]:
        words = words_of(text)
        return [m for index in self.parts for m in index.matches(words)]


def _indexes(benchmark: DataFrame, threshold: float, most: int, most_bytes: int = ITEM_BYTES) -> Iterator[Indexes]:
    """Indexes of about ``most`` items and ``most_bytes`` at most: the driver holds one block of items, and its words' counts, at a time."""
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"])
    schema = "item_id long, text string, size long, terms array<binary>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("text"), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["item_id", "text", "size", "terms"])

    own = stored(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, schema).filter("size > 0"), "items")
    total = own.agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    counts = stored(own.select(F.explode("terms").alias("word")).groupBy("word").count(), "terms")
    blocks = max(-(-total.n // most), -(-(total.bytes or 0) // most_bytes))
    for k in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        df = counts.join(part.select(F.explode("terms").alias("word")).distinct(), "word", "left_semi").collect()
        yield Indexes([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], threshold, {bytes(r.word): r["count"] for r in df}, total.n, total.words / total.n)


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): a row for each verified item of a text."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    out = documents.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark, threshold, most):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in shared.value.matches(t)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        out = out.union(texts.mapInArrow(find, schema))
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = ITEMS) -> DataFrame:
    """documents without those that hold a verified item; filtered where they are read."""
    for index in _indexes(benchmark, threshold, most):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = pa.array([not shared.value.matches((t or "").encode()) for t in b.column("text").to_pylist()], pa.bool_())
                yield b.filter(clean)

        documents = documents.mapInArrow(keep, documents.schema)
    return documents


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the benchmark items that documents hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
