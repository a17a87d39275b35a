"""URL filters: dated list entries become validity intervals, and an as-of join finds those active at each fetch.

An entry (category, pattern, action, at) adds a domain to a list or removes it; it holds until the next entry of the
same category and pattern. A capture is looked up under its host and every parent domain. Time is cut into slots, and
these are joined in pairs, fours and so on: an interval of n slots is entered under the O(log n) of these spans that
make it up, a capture under the one that holds it of each length that some interval of the pattern has. The join is one
on (pattern, span) with the exact bounds as a residual. An entry without an end is copied O(log n) times; the captures of
a popular domain share few keys, which are dealt out in parts.

Defined cases: a null or hostless url, or a null fetch time, matches nothing; entries with a null field are
ignored; entries at one time count in the order of ``seq``, and only the last holds; repeated captures and entries count
each and once; empty tables give no rows or no matches; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spritespark.llm.common import joined_in_parts, stored, table

#: Length of a slot, in seconds.
SLOT = 2 * 86_400


def host_of(url: Column) -> Column:
    """The lower-case host of a url, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domains_of(host: Column) -> Column:
    """The host and its parents, longest first, down to two labels."""
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame, slot: int = SLOT) -> DataFrame:
    """(category, pattern, since, until): half-open times in seconds at which an added entry holds; until null: for ever.

    The next entry is found within each slot of time; the last of a slot takes the first of the next slot that has any,
    so that a pattern with very many entries is never ordered as one.
    """
    at = entries.dropna(subset=["category", "pattern", "action", "at", "seq"]).select("category", "pattern", "action", F.unix_timestamp("at").alias("since"), "seq")
    at = at.groupBy("category", "pattern", "since").agg(F.max_by("action", F.struct("seq", "action")).alias("action")).withColumn("slot", F.floor(F.col("since") / slot))
    key = ["category", "pattern"]
    firsts = at.groupBy(*key, "slot").agg(F.min("since").alias("first"))
    firsts = firsts.select(*key, "slot", F.lead("first").over(Window.partitionBy(*key).orderBy("slot")).alias("after"))
    inside = F.lead("since").over(Window.partitionBy(*key, "slot").orderBy("since"))
    return at.withColumn("inside", inside).join(firsts, [*key, "slot"]).filter("action = 'add'").select(*key, "since", F.coalesce("inside", "after").alias("until"))


def spans_of(first: Column, last: Column, most: int) -> Column:
    """Array of (level, node) that make up the slots from first to last, 0 to ``most``: node k of a level is the slots from
    k * 2^level on. Empty where first > last."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(first.cast("bigint").alias("a"), (last + 1).cast("bigint").alias("b"), none.alias("out"))

    def up(q: Column, level: Column) -> Column:
        a, b = q["a"], q["b"]
        node = lambda odd, k: F.when((a < b) & (odd.bitwiseAND(F.lit(1)) == 1), F.array(F.struct(level.alias("level"), k.alias("node")))).otherwise(none)
        return F.struct(F.shiftright(a + a.bitwiseAND(F.lit(1)), 1).alias("a"), F.shiftright(b - b.bitwiseAND(F.lit(1)), 1).alias("b"), F.concat(q["out"], node(a, a), node(b, b - 1)).alias("out"))

    return F.aggregate(F.array(*(F.lit(k) for k in range((max(0, most) + 1).bit_length() + 1))), start, up, lambda q: q["out"])


def active_entries(captures: DataFrame, entries: DataFrame, slot: int = SLOT) -> DataFrame:
    """captures: page_id, url, fetched. One row per capture: page_id, n_active, categories, pattern.

    n_active: entries that hold at the fetch; categories: theirs, in order, comma-joined; pattern: the longest.
    """
    held = intervals(entries, slot)
    rows = captures.select("page_id", F.unix_timestamp("fetched").alias("t"), host_of(F.col("url")).alias("host")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "captures")  # its rows keep their number
    # an interval without an end reaches the last slot of any capture: two numbers
    lo, hi = rows.agg(F.min(F.floor(F.col("t") / slot)), F.max(F.floor(F.col("t") / slot))).first()
    lo, hi = (0, -1) if lo is None else (lo, hi)
    held = held.withColumn("span", F.explode(spans_of(F.expr(f"greatest(floor(since / {slot}), {lo}) - {lo}"), F.expr(f"least({hi}, coalesce(floor((until - 1) / {slot}), {hi})) - {lo}"), hi - lo)))
    held = held.select("category", "pattern", "since", "until", "span.level", "span.node")
    held = stored(held, "held")
    asked = stored(rows.filter("host <> '' AND t IS NOT NULL").select("row", "page_id", "t", F.explode(domains_of(F.col("host"))).alias("pattern")), "asked")
    spans = stored(joined_in_parts(asked, held.select("pattern", "level").distinct(), ["pattern"], ["row"]).withColumn("node", F.expr(f"shiftright(CAST(floor(t / {slot}) - {lo} AS BIGINT), level)")), "spans")
    found = joined_in_parts(spans, held, ["pattern", "level", "node"], ["row"]).filter("since <= t AND (until IS NULL OR t < until)")
    each = rows.select("page_id", "row", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("category")).union(found.select("page_id", "row", "pattern", "category"))
    return each.groupBy("row", "page_id").agg(F.count("category").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.coalesce(F.max_by("pattern", F.struct(F.length("pattern"), "pattern")), F.lit("")).alias("pattern")).drop("row")


def derived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list from the given tables: events of a user list or delist the host of the page of that number."""
    events, pages = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    host = pages.select(F.col("page_id").alias("user_id"), host_of(F.col("url")).alias("host"))
    rows = events.select("event_id", "ts", "user_id", "event_type").join(host, "user_id")
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    return rows.select(F.col("event_type").alias("category"), F.when((F.col("event_id") % 5 == 0) & (F.size(F.split("host", r"\.")) > 2), parent).otherwise(F.col("host")).alias("pattern"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def listed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page, as fetched at a time that its number gives, against the entries that held then."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7919, F.lit(30 * 86_400))).alias("fetched"))
    return active_entries(pages, derived_entries(spark, sf_dir))
