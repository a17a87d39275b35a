"""Document fingerprints: SimHash over weighted terms, and permuted block tables for search within a Hamming radius.

Terms are pairs of neighbouring words (one word where there is no other), weighted by their characters, so that short
function words count little. Every term's 128 hash bits vote with its weight; two votes share one long sum, 32 bits
each, so a text's votes stay exact up to 2^31. Only DataFrame functions run: the votes of a text are summed where its
words were split, then one small row a text is shuffled.

``within_radius`` finds all pairs: fingerprints at most r bits apart agree in one of r + 1 blocks, so each fingerprint
is entered under every block, and a pair is kept in the first table in which it agrees. Equal fingerprints stand
for one class there and are never multiplied; blocks that many share are split by further blocks. n_near counts the
other rows, equal ones too, within RADIUS of a document's own fingerprint.

Defined cases: a null text counts as empty; an empty text has fingerprint zero; a null doc_id has no next document
(its edited text is the part it keeps, near_next is null); rows that repeat a doc_id and text give one row, n_rows
being their number, and where an id holds several texts its neighbours see the least of them; one document alone is its own next; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spritespark.llm.common import joined, joined_in_parts, stored, table

BITS = 128
HEAVIEST = 24
RADIUS = 3
#: Blocks of more fingerprints are split, so often at most; what then still agrees has few bits left to differ in.
HOT = 256
LEVELS = 5
_SPLIT = "[\\x20\\x09-\\x0D]+"


def terms(text: Column) -> Column:
    """Array of (a, b): neighbouring words; b is empty in a text of one word."""
    words = F.array_remove(F.split(F.lower(text), _SPLIT), "")
    n = F.size(words)
    first = F.when(n > 1, F.slice(words, 1, n - 1)).otherwise(words)
    second = F.when(n > 1, F.slice(words, 2, n)).otherwise(F.transform(words, lambda _: F.lit("")))
    return F.arrays_zip(first.alias("a"), second.alias("b"))


def _votes(h: Column, w: Column) -> list[Column]:
    """32 sums for the 64 bits of h: bit i in the low half, bit i + 32 in the high half of a long."""
    return [F.sum((F.shiftrightunsigned(h, i).bitwiseAND(F.lit((1 << 32) + 1))) * w) for i in range(32)]


def _word(prefix: str) -> Column:
    """The signs of 64 votes as a long: a bit is set where its votes outweigh half of the total."""
    bits = [F.when(2 * F.col(f"{prefix}{i}").bitwiseAND(F.lit((1 << 32) - 1)) > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
    bits += [F.when(2 * F.shiftrightunsigned(F.col(f"{prefix}{i}"), 32) > F.col("total"), F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0)) for i in range(32)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return F.coalesce(bits[0].cast("long"), F.lit(0).cast("long"))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_rows, hi, lo): number and 128 bits of each group of rows with equal keys; one text for each is meant."""
    each = texts.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("i", "t")).select(*keys, F.expr("coalesce(i, 0) = 0").cast("long").alias("first"), F.xxhash64("t.a", "t.b").alias("h"), F.least(F.length("t.a") + F.length("t.b"), F.lit(HEAVIEST)).cast("long").alias("w"))
    each = each.withColumn("w", F.coalesce("w", F.lit(0).cast("long"))).withColumn("g", F.xxhash64("h", F.lit(1)))
    votes = [v.alias(f"p{i}") for i, v in enumerate(_votes(F.col("h"), F.col("w")))] + [v.alias(f"q{i}") for i, v in enumerate(_votes(F.col("g"), F.col("w")))]
    return each.groupBy(*keys).agg(F.sum("first").alias("n_rows"), F.sum("w").alias("total"), *votes).select(*keys, "n_rows", _word("p").alias("hi"), _word("q").alias("lo"))


def _hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(hi1: str, lo1: str, hi2: str, lo2: str) -> Column:
    """The share of equal bits."""
    return 1 - (F.bit_count(F.col(hi1).bitwiseXOR(F.col(hi2))) + F.bit_count(F.col(lo1).bitwiseXOR(F.col(lo2)))) / F.lit(float(BITS))


def _partition(level: int, n: int) -> list[tuple[int, int]]:
    """Masks (hi, lo) of n blocks that share out the 128 bits: runs of bits, at further levels in another order each."""
    order = list(range(BITS))
    if level:
        random.Random(level).shuffle(order)
    masks = [sum(1 << i for i in order[t * BITS // n : (t + 1) * BITS // n]) for t in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(m >> 64), signed(m & ((1 << 64) - 1))) for m in masks]


def _entries(prints: DataFrame, level: int, n: int) -> DataFrame:
    """Every row of prints (hi, lo, block, t0..) under each block of a level, inside the block it had."""
    blocks = [F.struct(F.lit(t).alias("t"), F.xxhash64("block", F.lit(t), F.col("hi").bitwiseAND(F.lit(h)), F.col("lo").bitwiseAND(F.lit(w))).alias("b")) for t, (h, w) in enumerate(_partition(level, n))]
    before = [f"t{i}" for i in range(level)]
    return prints.select("hi", "lo", "rows", *before, F.explode(F.array(*blocks)).alias("e")).select("hi", "lo", "rows", *before, F.col("e.t").alias(f"t{level}"), F.col("e.b").alias("block"))


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose block holds others, too, with their number n."""
    keys = [c for c in entries.columns if c not in ("hi", "lo", "rows")]
    sizes = stored(entries.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    return stored(joined(entries, sizes, keys, "n"), "blocks")


def within_radius(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(hi1, lo1, rows1, hi2, lo2, rows2, distance): all pairs of different fingerprints (hi, lo, rows) at most ``radius`` bits apart.

    radius + 1 tables, one for each block of bits, the join being the search in it. Blocks of more than ``hot``
    fingerprints are split by the blocks of another order of the bits, and so on: a pair within the radius agrees in
    one block of any order, so that none is lost. It is kept in the first block of each order in which it agrees. In each
    join the fingerprints of a large block are dealt out in parts; after LEVELS orders nearly all pairs that still meet are results.
    """
    if not 0 < radius < 16:
        raise ValueError("radius: 1 to 15")
    n = radius + 1
    x1, x2 = F.col("hi1").bitwiseXOR(F.col("hi2")), F.col("lo1").bitwiseXOR(F.col("lo2"))
    distance = F.bit_count(x1) + F.bit_count(x2)

    def first(level: int) -> Column:
        return F.coalesce(*(F.when((x1.bitwiseAND(F.lit(h)) == 0) & (x2.bitwiseAND(F.lit(w)) == 0), F.lit(t)) for t, (h, w) in enumerate(_partition(level, n))))

    rest, found = prints.dropna().groupBy("hi", "lo").agg(F.sum("rows").alias("rows")).withColumn("block", F.lit(0).cast("long")), None
    for level in range(LEVELS):
        met = _shared(_entries(rest, level, n))
        last = level == LEVELS - 1 or not met.filter(F.col("n") > hot).take(1)
        cool = met if last else met.filter(F.col("n") <= hot)
        keys = ["block", *(f"t{i}" for i in range(level + 1))]
        x, y = (cool.select(*keys, F.col("hi").alias(f"hi{i}"), F.col("lo").alias(f"lo{i}"), F.col("rows").alias(f"rows{i}")) for i in (1, 2))
        once = F.lit(True)
        for i in range(level + 1):
            once = once & (F.col(f"t{i}") == first(i))
        pairs = joined_in_parts(x, y, keys, ["hi1", "lo1"]).filter((F.struct("hi1", "lo1") < F.struct("hi2", "lo2")) & (distance <= radius) & once)
        pairs = pairs.select("hi1", "lo1", "rows1", "hi2", "lo2", "rows2", distance.alias("distance"))
        found = pairs if found is None else found.union(pairs)
        if last:
            return found
        rest = met.filter(F.col("n") > hot).drop("n")
    return found


def near_counts(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(hi, lo, size, n_near): how many rows have a fingerprint, and how many others one at most ``radius`` bits from it; prints: hi, lo, n_rows.

    Pairs are counted where they arise and never stored.
    """
    classes = stored(prints.groupBy("hi", "lo").agg(F.sum("n_rows").alias("rows"), F.count("*").alias("size")), "classes")
    both = F.array(*(F.struct(F.col(f"hi{i}").alias("hi"), F.col(f"lo{i}").alias("lo"), F.col(f"rows{3 - i}").alias("rows")) for i in (1, 2)))
    more = within_radius(classes, radius, hot).select(F.inline(both)).groupBy("hi", "lo").agg(F.sum("rows").alias("more"))
    return classes.join(more, ["hi", "lo"], "left").select("hi", "lo", "size", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, take, next_id): the next smaller doc_id, the largest after the smallest.

    Ids are dealt out in ranges, each range is ordered by itself, and the first of the next range follows its last:
    one row for each range is all that meets in one place.
    """
    ranged = stored(ids.repartitionByRange(F.col("doc_id").desc()).withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.max("doc_id").alias("first"))
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.max("first").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    w = Window.partitionBy("range").orderBy(F.desc("doc_id"))
    return ranged.withColumn("inside", F.lead("doc_id").over(w)).join(F.broadcast(firsts), "range").select("doc_id", "take", F.coalesce("inside", "after").alias("next_id"))  # firsts: a row for each partition


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Each document's and its edited text's fingerprints, their likeness, and how many rows' fingerprints are near."""
    # no alias around a doc_id that needs no cast: both uses of the texts then have the same plan, and share its shuffle
    own = F.col("doc_id") if dict(documents.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    texts = documents.select(own, F.coalesce("text", F.lit("")).alias("text"))
    live = texts.filter("doc_id IS NOT NULL")  # the same rows on both sides, so that their one shuffle serves both
    chain = following(live.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("take")))
    chain = stored(chain, "chain")
    given = live.join(chain.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), "take"), "doc_id").select(F.col("to").alias("doc_id"), F.col("text").substr(F.lit(1), F.col("take")).alias("given"))
    given = given.groupBy("doc_id").agg(F.min("given").alias("given"))
    third = F.floor(F.length("text") / 3).cast("int")
    whole = live.join(chain.select("doc_id", "next_id"), "doc_id").join(given, "doc_id", "left").select("doc_id", "text", "next_id", "given")
    whole = whole.union(texts.filter("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("long"), F.lit(None).cast("string")))
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.coalesce(F.col("given").substr(F.lit(1), third), F.lit("")))
    both = whole.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_hash"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["doc_id", "next_id", "n_chars", "text_hash", "edited_sha256"]
    each = both.select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "part"))
    prints = fingerprint(each, [*keys, "which"], "part")
    pick = lambda c, k: F.max(F.when(F.col("which") == k, F.col(c)))
    rows = stored(prints.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("ehi"), pick("lo", 1).alias("elo")), "prints")
    next_print = rows.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("hi", "lo")).alias("n")).select("next_id", F.col("n.hi").alias("nhi"), F.col("n.lo").alias("nlo"))
    rows = joined(rows, stored(near_counts(rows.select("hi", "lo", "n_rows")), "near"), ["hi", "lo"], "size")
    return rows.join(next_print, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", _hex("hi", "lo").alias("fingerprint"), _hex("ehi", "elo").alias("edited_fingerprint"), likeness("hi", "lo", "ehi", "elo").alias("near_edited"), likeness("hi", "lo", "nhi", "nlo").alias("near_next"), "n_rows", "n_near"
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of every document and of its edited text, and the number of near ones."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
