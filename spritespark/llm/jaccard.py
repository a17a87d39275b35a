"""N-gram Jaccard join: the product of the document-by-shingle incidence matrix with its transpose, in sparse blocks.

Rows are texts that differ in their words (documents with the same words share one row); columns are shingles. Two sets
of sizes n and m link when 100 * overlap >= 80 * union, that is 9 * overlap >= 4 * (n + m), so overlap >= 0.8 n.

1. Columns are dealt to as many blocks as the data need, and each block counts its columns' rows. Columns with one row
   have no product; a row left with fewer than 0.8 n columns can't link with any other and leaves the matrix.
2. In each remaining row the columns are ordered rarest first (one global order): an overlap of 0.8 n must start in the
   first n - ceil(0.8 n) + 1 of them, so only these are dealt to (column, row) cells.
3. A row is first multiplied with its columns' leaders alone (a row per entry, never all pairs of a column): in each
   column and band of sizes the row of the most common shingles, the least edited of a group of near copies. Parity
   bitmaps discard pairs exactly before whole rows move, as every bit in which they differ needs another shingle of one
   row only, and a link allows at most (n + m) / 9 of these. What is left is multiplied in full.
4. Columns in which rows of *different* components still meet are multiplied in cells of row blocks: each common column
   of a pair that sizes and bitmaps allow adds 1 to its overlap, the partial sums are added up, and pairs discarded
   whose overlap in these columns, with all that the remaining columns could add, stays below 4 (n + m) / 9. The
   remaining columns of the survivors are multiplied, and the whole overlap decides. No link between components is lost.

Defined cases: a null or empty text has an empty set, size 0, and is its own component; a null doc_id is not linked
and has a null component; repeated rows give equal rows; different texts of one doc_id are rows of their own, each with
its own links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spritespark.llm.common import discard, fresh, joined, stored, table, text_bytes
from spritespark.llm.components import components

WORDS = 5
#: Entries of a block of rows, and about as many of a block of columns.
BLOCK = 1 << 20
#: Longs of a parity bitmap.
PARITY = 8
#: Rows of a cell's side in a long column, and parts to which the pairs of a hot row are dealt.
SIDE, PARTS = 512, 64
#: Groups of rows up to this size are not hot, whatever their share.
SMALL = 256
#: Ids up to this many are broadcast to pick rows by them (16 bytes each); more are joined by shuffle.
FEW = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(tokens: list[bytes], hashes: _Hashes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of a text's words, sorted; all words as one where there are fewer."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out += (h[i : len(h) - n + 1 + i] ^ (h[i : len(h) - n + 1 + i] >> np.uint64(29))) * _ODD[i % 5]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    return _batch(schema, list(zip(*rows, strict=True)) or [[]] * len(schema.split(", ")))


def _sig(tokens: list[bytes]) -> bytes | None:
    """128 bits that tell texts of different words apart; None without words."""
    return xxhash.xxh3_128_digest(b" ".join(tokens)) if tokens else None


def with_sig(texts: DataFrame) -> DataFrame:
    """(doc_id, sig, words) of every row of texts (doc_id, text as bytes)."""

    def sigs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [t.lower().split() for t in b.column("text").to_pylist()]
            yield _batch("doc_id long, sig binary, words long", [b.column("doc_id"), [_sig(t) for t in tokens], [len(t) for t in tokens]])

    return texts.select("doc_id", "text").mapInArrow(sigs, "doc_id long, sig binary, words long")


def column_blocks(texts: DataFrame, blocks: int, words: int = WORDS) -> DataFrame:
    """The incidence matrix cut into blocks of rows and columns; with each row block, one row that lists its rows.

    part: the column block, or below 0 the row block of a listing (sigs and sizes). Entries: the row's place in its
    block (places) and 32 bits of the column (columns); a column's block follows from the other 32. Rows of a null
    doc_id are listed without entries; a text met twice in a row block is entered once.
    """
    schema = "part long, block long, sigs binary, sizes binary, places binary, columns binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = _Hashes(), TaskContext.get().partitionId() << 32
        sets, sigs, sizes, seen, held = [], [], [], set(), 0

        def out() -> Iterator[pa.RecordBatch]:
            all_ = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype="<u2"), [len(s) for s in sets])
            part = ((all_ >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            low, place, ends = (all_ & np.uint64(0xFFFFFFFF)).astype("<u4")[order], place[order], np.searchsorted(part[order], np.arange(blocks + 1))
            yield _rows(schema, [(-1 - block, block, b"".join(sigs), np.array(sizes, "<i4").tobytes(), None, None)])
            parts = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
            for i in range(0, len(parts), 256):
                yield _rows(schema, [(k, block, None, None, place[ends[k] : ends[k + 1]].tobytes(), low[ends[k] : ends[k + 1]].tobytes()) for k in parts[i : i + 256]])

        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = t.lower().split()
                sig = _sig(tokens)
                if sig is None or (sig, doc_id is None) in seen:
                    continue
                seen.add((sig, doc_id is None))
                s = shingle_set(tokens, hashes, words)
                sigs.append(sig)
                sizes.append(len(s))
                sets.append(s if doc_id is not None else s[:0])
                held += len(s)
                if held >= BLOCK or len(sets) == 1 << 16:
                    yield from out()
                    sets, sigs, sizes, seen, held, block = [], [], [], set(), 0, block + 1
        if sets:
            yield from out()

    return texts.mapInArrow(deal, schema)


def incidence(texts: DataFrame, blocks: int, words: int = WORDS) -> DataFrame:
    """(key, sig, n, pos, band, w): the first columns (keys) of the rows that can link, each row's in one global order.

    n: the row's size, pos: the column's place in its order, w: how common its shingles are (greater first when
    negated, as here). And a row of pos -1 without a key for every row of the matrix.
    """
    counted, ranked = "block long, part long, sigs binary, sizes binary, places binary, columns binary, counts binary", "key long, sig binary, n int, pos int, band int, w int"

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "sigs", "sizes", "places", "columns")), strict=True)]
        if k < 0:
            yield _rows(counted, [(b, k, s, n, None, None, None) for b, s, n, _, _ in rows])
            return
        columns = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
        _, which, times = np.unique(columns, return_inverse=True, return_counts=True)
        times, at, out = np.minimum(times, 65535).astype("<u2")[which], 0, []
        for b, _, _, places, own in rows:
            n = len(own) // 4
            several = times[at : at + n] > 1
            if several.any():
                out.append((b, k, None, None, np.frombuffer(places, "<u2")[several].tobytes(), columns[at : at + n][several].tobytes(), times[at : at + n][several].tobytes()))
            at += n
        yield _rows(counted, out)

    def rank(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs = sizes = None
        places, keys, times = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)], [np.zeros(0, "<u2")]
        for b in batches:
            for part, s, n, p, c, t in zip(*(b.column(c).to_pylist() for c in counted.replace(" long", "").replace(" binary", "").split(", ")[1:]), strict=True):
                if part < 0:
                    sigs, sizes = [s[i : i + 16] for i in range(0, len(s), 16)], np.frombuffer(n, "<i4").astype(np.int64)
                else:
                    places.append(np.frombuffer(p, "<u2"))
                    keys.append((part << 32) | np.frombuffer(c, "<u4").astype(np.int64))
                    times.append(np.frombuffer(t, "<u2"))
        place, key, time = np.concatenate(places).astype(np.int64), np.concatenate(keys), np.concatenate(times).astype(np.int64)
        m = np.bincount(place, minlength=len(sizes))
        common = (64 * np.bincount(place, np.log2(time + 1.0), len(sizes)) / np.maximum(sizes, 1)).astype(np.int64)
        first = np.where(5 * m >= 4 * sizes, m - (4 * sizes + 4) // 5 + 1, 0)
        order = np.lexsort((key, time, place))
        place, key = place[order], key[order]
        pos = np.arange(len(place)) - np.repeat(np.r_[0, m.cumsum()[:-1]], m)
        kept = pos < first[place]
        place, key, pos = place[kept], key[kept], pos[kept]
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25) + 1e-9).astype(np.int64)
        none = np.zeros(len(sizes), np.int64)
        yield _batch(ranked, [[None] * len(sizes), sigs, sizes, none - 1, band, -common])
        yield _batch(ranked, [key, [sigs[i] for i in place.tolist()], sizes[place], (sizes - m)[place] + pos, band[place], -common[place]])

    return column_blocks(texts, blocks, words).groupBy("part").applyInArrow(count, counted).groupBy("block").applyInArrow(rank, ranked)


def shared_columns(entries: DataFrame) -> DataFrame:
    """(key, sig, pos, leader) of columns with two rows or more; each band of sizes has its own leader.

    Leaders and counts are combined before they are shuffled, and hot columns get theirs by a broadcast: no task holds one.
    """
    bands = stored(entries.groupBy("key", "band").agg(F.min(F.struct("w", "sig")).alias("first"), F.count("*").alias("k")), "bands")
    several = bands.groupBy("key").agg(F.sum("k").alias("rows")).filter("rows > 1")
    leaders = stored(bands.join(several, "key", "left_semi").select("key", "band", F.col("first.sig").alias("leader"), "k"), "leaders")
    discard(bands)
    return joined(entries, leaders, ["key", "band"], "k", SMALL).select("key", "sig", "pos", "leader")


def _parity(s: np.ndarray) -> np.ndarray:
    """Of each of 64 * PARITY bits, whether an odd number of the set's hashes fall to it."""
    odd = np.bincount(((s >> np.uint64(24)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def whole_rows(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(sig, n, row, p0..): the size, all columns and the parity bitmap of each row."""
    schema = "sig binary, n int, row binary, " + ", ".join(f"p{i} long" for i in range(PARITY))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            tokens = [w for t in b.column("text").to_pylist() if (w := t.lower().split())]
            sets = [shingle_set(w, hashes, words) for w in tokens]
            yield _batch(schema, [[_sig(w) for w in tokens], [len(s) for s in sets], [s.tobytes() for s in sets], *np.array([_parity(s) for s in sets], np.int64).reshape(-1, PARITY).T])

    return texts.select("text").mapInArrow(rows, schema)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW else ids


def attached(pairs: DataFrame, rows: DataFrame, side: str, other: str, names: dict[str, str]) -> DataFrame:
    """pairs (stored) with columns of rows (stored; one for each sig) under new names, by the pair's ``side``.

    A row with more than its share of pairs is copied to PARTS parts, to which its pairs are dealt by their other side;
    where there is none, one join does all.
    """
    degrees = pairs.groupBy(F.col(side).alias("sig")).agg(F.count("*").alias("d"))
    ids, most, total = degrees.agg(F.count("*"), F.max("d"), F.sum("d")).first()
    limit, few = max(SIDE, (total or 0) / PARTS / 10), degrees.select("sig")
    own = rows.join(F.broadcast(few) if ids <= FEW else few, "sig", "left_semi")
    if (most or 0) <= limit:
        return pairs.join(own.select(F.col("sig").alias(side), *(F.col(c).alias(n) for c, n in names.items())), side)
    hot = stored(degrees.filter(F.col("d") > limit).select("sig", F.lit(1).alias("hot")), "hot")  # at most 10 PARTS rows
    dealt = pairs.join(F.broadcast(hot.withColumnRenamed("sig", side)), side, "left").withColumn("part", F.when(F.col("hot") == 1, F.pmod(F.xxhash64(other), F.lit(PARTS))).otherwise(0).cast("int")).drop("hot")
    of = own.join(F.broadcast(hot), "sig", "left")
    of = of.select(F.col("sig").alias(side), F.explode(F.when(F.col("hot") == 1, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"), *(F.col(c).alias(n) for c, n in names.items()))
    return dealt.join(of, [side, "part"]).drop("part")


def _within(x: str = "1", y: str = "2"):
    """Whether sizes and parity bitmaps of two rows allow a link."""
    differ = " + ".join(f"bit_count(p{i}{x} ^ p{i}{y})" for i in range(PARITY))
    return F.expr(f"5 * least(n{x}, n{y}) >= 4 * greatest(n{x}, n{y}) AND 9 * ({differ}) <= n{x} + n{y}")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The overlap of each left row with the right row at its place: every common column adds 1 to its pair's count."""
    at = np.arange(len(left))
    pair = np.concatenate([np.repeat(at, [len(s) for s in left]), np.repeat(at, [len(s) for s in right])])
    column = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    order = np.lexsort((column, pair))
    pair, column = pair[order], column[order]
    return np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (column[1:] == column[:-1])], minlength=len(left))


def multiplied(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link by the overlap of their whole rows."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = list(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True))
            s, t = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("s", "t"))
            first = 0
            while first < len(ids):  # parts of bounded size, or one pair
                last, held = first, 0
                while last < len(ids) and (last == first or held + len(s[last]) + len(t[last]) <= BLOCK):
                    held, last = held + len(s[last]) + len(t[last]), last + 1
                sums = overlaps(s[first:last], t[first:last])
                yield _rows("a binary, b binary", [ids[i] for i in range(first, last) if 9 * sums[i - first] >= 4 * (len(s[i]) + len(t[i]))])
                first = last

    half = stored(attached(pairs, rows, "b", "a", {"row": "t"}), "halves")
    return attached(half, rows, "a", "b", {"row": "s"}).select("a", "b", "s", "t").mapInArrow(product, "a binary, b binary")


def cells(left: DataFrame) -> DataFrame:
    """(a, b): pairs of rows of different components c whose overlap in left's columns allows a link.

    left: key, k (rows of the column), sig, c, n, pos, p0... A long column is cut into blocks of about SIDE rows, and
    each pair of blocks is a cell; every common column of a pair adds 1.
    """
    sides = F.ceil(F.col("k") / SIDE).cast("int")
    cut = left.withColumn("own", F.pmod(F.xxhash64("sig"), sides).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), sides - 1)))
    given = ["sig", "c", "n", "pos", *(f"p{i}" for i in range(PARITY))]
    x = cut.select("key", F.col("own").alias("i"), F.col("each").alias("j"), *(F.col(c).alias(f"{c}1") for c in given))
    y = cut.select("key", F.col("each").alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{c}2") for c in given))
    met = x.join(y, ["key", "i", "j"]).filter(F.expr("c1 < c2") & _within()).select(F.least("sig1", "sig2").alias("a"), F.greatest("sig1", "sig2").alias("b"), "n1", "n2", F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")).alias("rest"))
    sums = met.groupBy("a", "b").agg(F.count("*").alias("overlap"), F.max("rest").alias("rest"), F.max(F.col("n1") + F.col("n2")).alias("both"), F.max(F.greatest("n1", "n2")).alias("longer"))
    # common columns are counted here, or lie beyond the first columns of one row; none lies before the first one met
    return sums.filter("9 * least(overlap + (4 * longer + 4) div 5 - 1, rest) >= 4 * both").select("a", "b")


def _linked(texts: DataFrame, standing: DataFrame, entries: DataFrame, words: int) -> DataFrame:
    """(id, component) of the rows that have links, both as sigs."""
    shared = stored(shared_columns(entries.filter("pos >= 0")), "columns")
    met = shared.select("sig").distinct()
    wanted = standing.join(met, "sig", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    rows = whole_rows(texts.join(_few(wanted), "doc_id", "left_semi"), words)
    rows = stored(rows.join(_few(met), "sig", "left_semi"), "rows")
    if rows.groupBy("sig").count().filter("count > 1").limit(1).count():  # repeated rows of documents
        rows = stored(rows.dropDuplicates(["sig"]), "rows")
    bitmap = ["n", *(f"p{i}" for i in range(PARITY))]
    stars = stored(shared.filter("sig <> leader").select(F.col("leader").alias("a"), F.col("sig").alias("b")).distinct(), "stars")
    half = stored(attached(stars, rows, "b", "a", {c: f"{c}2" for c in bitmap}), "halves")
    tried = stored(attached(half, rows, "a", "b", {c: f"{c}1" for c in bitmap}).filter(_within()).select("a", "b"), "stars")
    discard(half)
    links = stored(multiplied(tried, rows), "links")
    labels = components(links)
    # columns where rows of several components meet
    known = stored(shared.join(labels.select(F.col("id").alias("sig"), "component"), "sig", "left").select("key", "sig", "pos", F.coalesce("component", "sig").alias("c")), "labelled")
    meeting = stored(known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("key", "k"), "meeting")
    left = joined(known, meeting, ["key"], "k", SMALL).join(rows.select("sig", *bitmap), "sig")
    both = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = stored(cells(stored(left, "open")).join(both, ["a", "b"], "left_anti"), "cross")
    if not cross.limit(1).count():
        return labels
    more = stored(multiplied(cross, rows), "more")
    return components(stored(links.union(more), "links")) if more.limit(1).count() else labels


def jaccard_rows(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, sig, n_shingles, c, component_id), a row for each of texts (doc_id, text as bytes); c: the component, as a sig."""
    ids = stored(with_sig(texts), "ids")
    standing = stored(ids.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.max("words").alias("words")), "standing")
    # documents whose words another one stands for are not read again
    spare = joined(ids.filter("sig IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "sig"), standing, ["sig"], "rows", SMALL).groupBy("doc_id").agg(F.min(F.expr("doc_id <> rep")).alias("spare")).filter("spare").select("doc_id")
    spare = stored(spare, "spare")
    entered = texts.join(_few(spare), "doc_id", "left_anti")
    blocks = 1 + (standing.agg(F.sum("words")).first()[0] or 0) // BLOCK
    entries = stored(incidence(entered, blocks, words), "entries")
    labels = _linked(entered, standing, entries, words)
    sizes = entries.filter("pos < 0").groupBy("sig").agg(F.max("n").alias("n"))
    named = stored(standing.join(sizes, "sig").join(labels.select(F.col("id").alias("sig"), "component"), "sig", "left").select("sig", "rep", "rows", "n", F.coalesce("component", "sig").alias("c")), "named")
    least = stored(named.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("texts")), "least")
    named = stored(joined(named, least, ["c"], "texts", SMALL).select("sig", "rows", "n", "c", "component_id"), "named")
    live = F.col("doc_id").isNotNull()
    found = joined(ids.filter("sig IS NOT NULL").select("doc_id", "sig"), named, ["sig"], "rows", SMALL).select("doc_id", "sig", F.col("n").cast("long").alias("n_shingles"), "c", F.when(live, F.col("component_id")).alias("component_id"))
    return found.union(ids.filter("sig IS NULL").select("doc_id", "sig", F.lit(0).cast("long"), "sig", "doc_id"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def jaccard_components(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of documents."""
    return jaccard_rows(_texts(documents), words).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """documents without those that link to one of a smaller doc_id, and one row of each text of a doc_id; all columns stay.

    Only ids move: those to drop are broadcast up to FEW, and joined by shuffle beyond. A null doc_id stays. Of rows
    with one doc_id, those of one component count as repeated: the first stays, in the order of all their columns.
    """
    found = stored(jaccard_rows(_texts(documents), words), "groups").filter("doc_id IS NOT NULL")
    again = stored(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    away = found.filter("component_id <> doc_id").select("doc_id").union(again).distinct()
    kept = documents.join(_few(away), "doc_id", "left_anti")
    if again.limit(1).count():
        own, sig, names = documents.columns, fresh(documents, "sig"), [F.col(f"`{c}`") for c in documents.columns]
        several = documents.join(_few(again), "doc_id", "left_semi").select(*names)
        of_id, of_sig, of_c = (fresh(documents, f"{sig}_{x}") for x in ("id", "text", "c"))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sigs = [_sig((t or "").encode().lower().split()) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.binary())], names=[*b.schema.names, sig])

        stay = found.join(_few(again), "doc_id", "left_semi").filter("component_id = doc_id").select(F.col("doc_id").alias(of_id), F.col("sig").alias(of_sig), F.col("c").alias(of_c)).distinct()
        marked = several.mapInArrow(add, several.withColumn(sig, F.lit(None).cast("binary")).schema).join(_few(stay), (F.col("doc_id") == F.col(of_id)) & F.col(sig).eqNullSafe(F.col(of_sig)))
        firsts = marked.groupBy(of_id, of_c).agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("_row"))
        kept = kept.select(*names).unionByName(firsts.select(*(F.col(f"_row.`{c}`").alias(c) for c in own)))
    return kept.select(*(f"`{c}`" for c in documents.columns))


def shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's component under the 0.8 Jaccard links of its five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
