"""Tags inside tags and overlapping tags, as a player shows them."""

from pyspark.sql import functions as F

from spritespark.operators import playback as P
from spritespark.queries.registry import query
from spritespark.sources import fixtures as X

_TIMES = "flatten(list_transform(range({k}), lambda i: {l}))"


def _times(k, what):
    return _TIMES.format(k=k, l=what)


_NESTED = f"[0] || {_times('1+sprite_id%3', '[1] || ' + _times('2', 'list_reverse(range(2, n-2))').replace('lambda i', 'lambda j') + ' || [n-2]')} || [n-1]"
_LISTED = "SELECT sprite_id, k-1 AS step, l[k] AS frame FROM (SELECT sprite_id, l, unnest(range(1, len(l)+1)) AS k FROM o)"


@query("playback_nested", f"WITH o AS (SELECT sprite_id, CASE WHEN n<3 THEN range(n) WHEN n=3 THEN [0] || {_times('1+sprite_id%3', '[1]')} || [2] ELSE {_NESTED} END AS l FROM turns) {_LISTED}")
def playback_nested(spark, d):
    """A repeated tag from 1 to the last but one frame, and in it one that goes back twice."""
    t = X.turns(spark, d)
    tag = lambda a, b, way, rep: F.struct(F.lit(a).alias("from_frame"), b.cast("int").alias("to_frame"), F.lit(way).alias("dir"), rep.cast("int").alias("rep"))
    n = F.col("n")
    tags = t.select("sprite_id", F.explode(F.array(tag(1, n - 2, P.FORWARD, 1 + F.col("sprite_id") % 3), tag(2, n - 3, P.REVERSE, F.lit(2)))).alias("t")).select("sprite_id", "t.*").filter("from_frame <= to_frame")
    return P.playback(t, tags)


_H = "n//2"
_FIRST, _SECOND = _times("1+sprite_id%2", f"range({_H}+1)"), _times("1+sprite_id%3", f"range({_H}, n)")
_SMALL = f"CASE WHEN n=1 THEN {_times('(1+sprite_id%2)*(1+sprite_id%3)', '[0]')} WHEN n=2 THEN {_times('1+sprite_id%2', '[0] || ' + _times('1+sprite_id%3', '[1]').replace('lambda i', 'lambda j'))} ELSE {_FIRST} || {_SECOND} END"


@query("playback_cascade", f"WITH o AS (SELECT sprite_id, {_SMALL} AS l FROM turns) {_LISTED}")
def playback_cascade(spark, d):
    """Two repeated tags that share their middle frame: the second is played from its beginning when the first has ended."""
    t, i = X.turns(spark, d), F.col("sprite_id")
    half = F.floor(F.col("n") / 2)
    tag = lambda a, b, rep: F.struct(a.cast("int").alias("from_frame"), b.cast("int").alias("to_frame"), F.lit(P.FORWARD).alias("dir"), rep.cast("int").alias("rep"))
    tags = t.select("sprite_id", F.explode(F.array(tag(F.lit(0), half, 1 + i % 2), tag(half, F.col("n") - 1, 1 + i % 3))).alias("t")).select("sprite_id", "t.*").filter("from_frame <= to_frame AND to_frame < 1000")
    clipped = tags.join(t, "sprite_id").withColumn("to_frame", F.least("to_frame", F.col("n") - 1)).drop("n")
    return P.playback(t, clipped)


@query("playback_loop", "WITH o AS (SELECT sprite_id, list_transform(range(20), lambda k: k % n) AS l FROM turns) SELECT sprite_id, k-1 AS step, l[k] AS frame FROM (SELECT sprite_id, l, unnest(range(1, 21)) AS k FROM o)")
def playback_loop(spark, d):
    """The first twenty frames of the loop without tags."""
    t = X.turns(spark, d)
    return P.playback(t, X.tags_tbl(spark, d).select("sprite_id", "from_frame", "to_frame", "dir", "rep"), "plain", 20)
