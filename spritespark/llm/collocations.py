"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass counts proposals and their border, failures of the border are made up for.

A share of the documents proposes phrases: words, and phrases of up to ``longest - 1`` words made of proposed ones, that occur
``lowered`` times in the sample. A full pass then counts, by language, all phrases whose two parts of one word less are
proposed: the proposals and their negative border, which at one word is the whole vocabulary. If a phrase of the border turns out to be
frequent, phrases made of it have not been counted yet. The expansion pass counts these, and with them whatever is made of
what it counts, so that it leaves no open border and one such pass closes the mining.

Phrases are counted by 64-bit hashes first, as two longs a row. Phrases of one hash are added up there, so that a frequent phrase is never
missed; the expansion pass counts what came out frequent by its words, so that all results are exact.

Proposals and frequent hashes are held as bits of a filter of fixed size, so what is broadcast has a bound whatever
the vocabulary. A filter's false positives make a pass count phrases needlessly, never wrongly.

Counting: a task turns words to numbers, counts phrases in blocks of BLOCK words by sorting and hands on one row a
phrase and block, so that a frequent phrase is no hot key; these are dealt out by key and added up.

Defined cases: a null text counts as empty, a null lang as ``und``; ties are broken by the phrase's bytes; repeated rows
count each; an empty table gives none; texts of any length are read in blocks that overlap by a phrase; other columns are
not read (doc_id serves the choice of the sample only and may be null).
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spritespark.llm.common import joined, stored, table

#: Words whose phrases are counted at a time, bytes of a text that are cut to words at a time, words a task remembers.
BLOCK, BYTES, REMEMBERED = 1_000_000, 1 << 22, 400_000
#: A filter has 2**BITS bits, of which a phrase sets SET.
BITS, SET = 26, 4
#: Parts of a language that are ranked before the whole.
PARTS = 64
#: Share of the documents in the sample.
SHARE = 0.25
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def longer_hash(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The hash of phrases that are one word longer."""
    x = (hashes ^ (hashes >> np.uint64(29))) * _MIX + following
    return x ^ (x >> np.uint64(32))


def _places(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the filter's 64-bit groups, and the bits in them, that stand for a hash."""
    for k in range(SET):
        place = (hashes >> np.uint64(12 * k)) * _MIX >> np.uint64(64 - BITS)
        yield (place >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), place & np.uint64(63))


class Filter:
    """A set of phrase hashes in 2**BITS bits; has() may say yes needlessly."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (BITS - 6), np.uint64) if bits is None else bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at, bit in _places(hashes):
            out &= (self.bits[at] & bit) != 0
        return out

    def with_hashes(self, found: DataFrame) -> Filter:
        """With those of a table (h); its bits are combined in the cluster, so that at most the filter's size comes to the driver."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, bit in _places(b.column("h").to_numpy().view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], names=["at", "bit"])

        found = found.select("h").mapInArrow(spread, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = self.bits.copy()
        bits[found.column("at").to_numpy()] |= found.column("bits").to_numpy().view(np.uint64)
        return Filter(bits)


class Stream:
    """Texts as numbers of words, block by block; 0 ends a piece. A language's words are a dict that numbers new ones on."""

    def __init__(self, longest: int):
        self.longest = longest
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, defaultdict] = {}
        self.next = itertools.count(1).__next__
        self.names, self.langs, self.hashes = [b""], [""], np.zeros(1, np.uint64)
        self.seen: dict[str, int] = {}
        self.held: list[np.ndarray] = []
        self.n = 0

    def _hold(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)

    def _look(self, lang: str) -> defaultdict:
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.next, {b".": 0})
            self.seen[lang] = 1
        return self.ids[lang]

    def _learn(self) -> None:
        """Names, languages and hashes of the words that are new."""
        more = 1 + sum(len(own) - 1 for own in self.ids.values()) - len(self.names)
        self.names += [b""] * more
        self.langs += [""] * more
        self.hashes = np.r_[self.hashes, np.zeros(more, np.uint64)]
        for lang, own in self.ids.items():
            seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
            for word, i in itertools.islice(own.items(), self.seen[lang], None):
                self.names[i], self.langs[i], self.hashes[i] = word, lang, xxhash.xxh64_intdigest(word, seed)
            self.seen[lang] = len(own)

    def read(self, lang: str, text: bytes) -> Iterator[tuple[np.ndarray, int]]:
        at = 0
        while at < len(text):
            cut = text.find(b" ", at + BYTES) if len(text) - at > BYTES else -1
            part, at = (text[at:cut], cut) if cut >= 0 else (text[at:] if at else text, len(text))
            words = part.translate(_FOLD).replace(b".", b" . ").split()
            self._hold(np.fromiter(map(self._look(lang).__getitem__, words), np.int32, len(words)))
            if self.n > BLOCK:
                yield from self.block(False)
        self._hold(np.zeros(1, np.int32))

    def block(self, last: bool = True) -> Iterator[tuple[np.ndarray, int]]:
        """The numbers held, and before which place phrases are to be counted: the last words begin phrases of the next block."""
        ids = np.concatenate([*self.held, np.zeros(1 if last else 0, np.int32)])
        begins = len(ids) - (0 if last else min(self.longest - 1, len(ids)))
        self._learn()
        yield ids, begins
        carried = [(self.langs[i], self.names[i] or b".") for i in ids[begins:]]
        if len(self.names) > REMEMBERED:
            self._forget()
        self.held, self.n = [], 0
        if carried:
            self._hold(np.array([self._look(lang)[word] for lang, word in carried], np.int32))

    def phrases(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: whether a phrase that begins at a place lies in one piece, and its hash."""
        phrase, inside = self.hashes[ids], ids != 0
        yield 1, inside, phrase
        for k in range(2, self.longest + 1):
            phrase, inside = longer_hash(phrase[:-1], self.hashes[ids[k - 1 :]]), inside[:-1] & (ids[k - 1 :] != 0)
            yield k, inside, phrase


def _and_has(chosen: np.ndarray, phrase: np.ndarray, found: Filter) -> np.ndarray:
    """chosen, where the filter has the phrase."""
    out = chosen.copy()
    out[chosen] = found.has(phrase[chosen])
    return out


def hash_counts(stream: Stream, ids: np.ndarray, begins: int, proposed: Filter, only: int | None = None) -> Iterator[pa.RecordBatch]:
    """(h, n) of all phrases whose parts are proposed; of one length only, if ``only``."""
    part = None
    for k, inside, phrase in stream.phrases(ids):
        counted = inside if k == 1 else inside & part[:-1] & part[1:]
        if only in (None, k):
            if k == 1:
                n = np.bincount(ids[:begins], minlength=len(stream.hashes))
                at = np.flatnonzero(n[1:]) + 1
                found, n = stream.hashes[at], n[at]
            else:
                found, n = np.unique(phrase[:begins][counted[:begins]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])
        if k == only or k == stream.longest:
            return
        part = _and_has(counted, phrase, proposed)


def phrase_counts(stream: Stream, ids: np.ndarray, begins: int, proposed: Filter, frequent: Filter) -> Iterator[pa.RecordBatch]:
    """(key, n) of the phrases that are frequent by their hashes or that the first pass did not count, all of whose parts are such; and
    all words of each language as the empty phrase."""
    n = np.bincount(ids[:begins], minlength=len(stream.names))
    for lang, own in stream.ids.items():
        mine = np.fromiter(own.values(), np.int64, len(own))
        if total := int(n[mine[mine > 0]].sum()):
            yield pa.RecordBatch.from_arrays([pa.array([f"\n{lang}"]), pa.array([total], pa.int64())], names=["key", "n"])
    names, langs = pa.array(stream.names, pa.binary()), pa.array(stream.langs, pa.string())
    part = chosen = None
    for k, inside, phrase in stream.phrases(ids):
        counted = inside if k == 1 else inside & part[:-1] & part[1:]
        able = inside if k == 1 else inside & chosen[:-1] & chosen[1:]
        chosen = _and_has(able & counted, phrase, frequent) | (able & ~counted)
        at = np.flatnonzero(chosen[:begins])
        if len(at):
            codes, shorter = ids[at].astype(np.int64), []
            for j in range(1, k):
                if j > 1:  # two words make a code; a longer phrase's begins with the rank of its first words
                    kinds, codes = np.unique(codes, return_inverse=True)
                    shorter.append(kinds)
                codes = (codes << 32) | ids[at + j]
            codes, n = np.unique(codes, return_counts=True)
            own = [] if k == 1 else [codes & 0xFFFFFFFF]
            for kinds in reversed(shorter):
                codes = kinds[codes >> 32]
                own.append(codes & 0xFFFFFFFF)
            yield from _rows([codes if k == 1 else codes >> 32, *reversed(own)], n, names, langs)
        if k < stream.longest:
            part = _and_has(counted, phrase, proposed)


def _rows(words: list[np.ndarray], n: np.ndarray, names: pa.Array, langs: pa.Array, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(n), size):
        own = [w[a : a + size] for w in words]
        phrase = pc.binary_join_element_wise(*(names.take(pa.array(w)) for w in own), pa.scalar(b" ", pa.binary())).cast(pa.string()) if len(own) > 1 else names.take(pa.array(own[0])).cast(pa.string())
        key = pc.binary_join_element_wise(phrase, langs.take(pa.array(own[0])), "\n")
        yield pa.RecordBatch.from_arrays([key, pa.array(n[a : a + size].astype(np.int64))], names=["key", "n"])


def _counted(texts: DataFrame, longest: int, count: Callable, schema: str) -> DataFrame:
    """count(stream, ids, begins) over all blocks, its rows' n added up by its first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(longest)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for ids, begins in stream.read(lang, (text.as_py() or "").encode()):
                    yield from count(stream, ids, begins)
        for ids, begins in stream.block():
            yield from count(stream, ids, begins)

    key = schema.split()[0]
    # a task's rows are sums already: they are dealt out by key as they are and added up there
    return texts.mapInArrow(run, schema).repartition(key).groupBy(key).agg(F.sum("n").alias("n"))


_LENGTH = "CASE WHEN key LIKE '\n%' THEN 0 ELSE size(split(substring_index(key, '\n', 1), ' ')) END"


def frequent_phrases(documents: DataFrame, least: int = 10, longest: int = 3, share: float = SHARE, lowered: int | None = None) -> DataFrame:
    """(lang, phrase, words, n): all phrases of at most ``longest`` words with n >= least, and each language's number of words as the empty phrase.

    share and lowered (by default what a phrase with ``least`` occurrences has in the sample, rounded) decide how much each
    pass counts, not the result.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", F.col("doc_id").cast("string").alias("doc_id"))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int(share * (1 << 20))).select("lang", "text")
    texts = texts.select("lang", "text")
    lowered = max(1, round(least * share + 0.5)) if lowered is None else lowered
    context = documents.sparkSession.sparkContext
    proposed = Filter()
    for k in range(1, longest):  # the sample's phrases of k words
        shared = context.broadcast(proposed)
        found = _counted(sample, longest, lambda *block, shared=shared, k=k: hash_counts(*block, shared.value, k), "h long, n long")
        proposed = proposed.with_hashes(found.filter(F.col("n") >= lowered))
    shared = context.broadcast(proposed)
    first = _counted(texts, longest, lambda *block: hash_counts(*block, shared.value), "h long, n long")
    both = context.broadcast((proposed, Filter().with_hashes(first.filter(F.col("n") >= least))))
    found = _counted(texts, longest, lambda *block: phrase_counts(*block, *both.value), "key string, n long")
    out = stored(found.withColumn("words", F.expr(_LENGTH)).filter(f"n >= {least} OR words = 0"), "phrases")
    return out.select(F.substring_index("key", "\n", 1).alias("phrase"), F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), "words", "n")


def collocations(phrases: DataFrame, kept: float = 50, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases by the score of their weakest cut, from what ``frequent_phrases`` gives (stored).

    A phrase goes if a longer one that contains it has at least ``kept`` per cent of its occurrences.
    """
    long = phrases.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = stored(
        long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.explode(F.expr("array(named_struct('left', true, 'part', array_join(slice(w, 1, k), ' ')), named_struct('left', false, 'part', array_join(slice(w, k + 1, size(w)), ' ')))")).alias("p"))
        .select("lang", "phrase", "a", "k", "p.*"), "cuts")
    parts = stored(cuts.groupBy("lang", "part").agg(F.count("*").alias("uses")).join(phrases.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"]), "parts")
    scored = (
        joined(cuts, parts, ["lang", "part"], "uses").groupBy("lang", "phrase", "a", "k")
        .agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
        .withColumn("score", F.expr("(1000000BD * CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inside = (
        long.filter(F.size("w") > 2).select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    left = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < kept * F.col("a"), F.lit(True)))
    order = [F.desc("cut.score"), F.desc("a"), "phrase"]
    # the first of each of PARTS parts of a language, then of what is left: no task gets more than PARTS * most rows of one
    part = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most).drop("rank", "part")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    sizes = phrases.filter("words = 0").select("lang", F.col("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the collocations of every language."""
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))
