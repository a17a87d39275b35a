"""Token counts without token ids: a text's count is the sum of its pre-tokens' counts, and each distinct pre-token is tokenized once.

The tokenizer never merges across pre-tokens, so a corpus needs one tokenization of its distinct pre-tokens instead of
one of its texts. First, tasks count pre-tokens and the totals give ``pieces`` (pre-token, occurrences, pieces). Then each
text's pre-token frequencies meet that table: the HOT most frequent pre-tokens, a bounded number of bounded length, are
broadcast and summed where the text is read; the frequencies of all others are joined by shuffle, in which none is frequent.

Pre-tokens are those of the tokenizers library. Below FAMILIAR the pattern's classes are written out for ``re``; a text
with other code points, on whose classes libraries of different age disagree, is cut by the tokenizer's own pre-tokenizer.
The special token's string counts as one token wherever it stands, which is the library's default.

Defined cases: a null text counts as empty (no bytes, no tokens); a null doc_id stays null; every input row gives one row,
repeated ones each; an empty table gives none; texts of any length are cut in blocks where a space follows another
character, which is always a border between pre-tokens; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import most_frequent, stored, table, vocabulary_path
from spritespark.llm.tokens import SPECIAL, _json

#: Pre-tokens that are broadcast with their counts, at most, and the most code points of one.
HOT, HOT_LENGTH = 200_000, 64
#: More tokens than this are over the limit.
LIMIT = 1024
#: Code points from here on are left to the tokenizer's own pre-tokenizer.
FAMILIAR = 0x530
#: Code points of a block, pre-tokens that a task holds before it hands them on, rare pre-tokens in a row.
BLOCK, HELD, CHUNK = 1 << 20, 500_000, 4_096


def _ranges(chosen) -> str:
    """A character class's inside for the code points below FAMILIAR that are chosen."""
    points = [c for c in range(FAMILIAR) if chosen(chr(c))]
    starts = [c for c in points if not chosen(chr(c - 1)) or c == 0] if points else []
    out = []
    for a in starts:
        b = a
        while b + 1 < FAMILIAR and chosen(chr(b + 1)):
            b += 1
        out.append(f"\\u{a:04x}-\\u{b:04x}")
    return "".join(out)


@cache
def _pattern() -> re.Pattern:
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = _ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_STRANGE = re.compile(f"[\\u{FAMILIAR:04x}-\\U0010ffff]")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in parts of about ``size``, cut before a space after another kind of character."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that doesn't hold the special token's string."""
    if _STRANGE.search(text):
        cutter = _json(vocabulary_path("byte_bpe_50k.json")).pre_tokenizer
        return [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)]
    return _pattern().findall(text)


def parts_of(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a whole text, block by block."""
    for piece in text.split(SPECIAL):
        for block in blocks(piece):
            yield pre_tokens(block)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for b in batches:
        for t in b.column("text"):
            for part in parts_of(t.as_py() or ""):
                held.update(part)
                if len(held) > HELD:
                    yield _rows(held)
                    held.clear()
    if held:
        yield _rows(held)


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = _json(vocabulary_path("byte_bpe_50k.json"))
    for b in batches:
        pieces = [len(cut.encode(x, add_special_tokens=False).ids) for x in b.column("piece").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(pieces, pa.int64())], names=["piece", "n", "pieces"])


def piece_counts(documents: DataFrame) -> DataFrame:
    """(piece, n, pieces): every distinct pre-token with its occurrences and its number of tokens, stored."""
    found = documents.select("text").mapInArrow(_counted, "piece string, n long")
    return stored(found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_tokenized, "piece string, n long, pieces long"), "pre_tokens")


class _Known(dict):
    """pre-token -> tokens; what is missing counts for nothing here and is noted."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missing.append(piece)
        return 0


def count_tokens(documents: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``hot`` bounds what is broadcast and changes no count."""
    counts = piece_counts(documents)
    frequent = most_frequent(counts.filter(F.length("piece") <= HOT_LENGTH), hot).select("piece", "pieces").toPandas()
    known = documents.sparkSession.sparkContext.broadcast(dict(zip(frequent.piece, frequent.pieces.tolist(), strict=True)))
    schema = "row long, doc_id long, n_bytes long, known long, rare array<struct<piece: string, times: long>>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = _Known(known.value), TaskContext.get().partitionId() << 33
        look = pieces.__getitem__
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                total, rare = text.count(SPECIAL), Counter()
                for part in parts_of(text):
                    total += sum(map(look, part))
                    rare.update(pieces.missing)
                    pieces.missing.clear()
                rare = [{"piece": p, "times": n} for p, n in rare.items()]
                out.append((row, i, len(text.encode()), total, rare[:CHUNK]))
                out += [(row, None, None, None, rare[k : k + CHUNK]) for k in range(CHUNK, len(rare), CHUNK)]
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names=["row", "doc_id", "n_bytes", "known", "rare"])

    measured = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, schema), "measured")
    rare = measured.select("row", F.inline("rare")).join(counts.select("piece", "pieces"), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    total = F.col("known") + F.coalesce("others", F.lit(0))
    return measured.filter("n_bytes IS NOT NULL").join(rare, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
