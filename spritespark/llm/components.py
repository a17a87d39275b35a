"""Connected components of a link table, by minimum labels with pointer jumping; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spritespark.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable. Only ids with links have a row.

    Each round takes the least label of the neighbours (a combinable minimum, so hubs don't pile up) and then
    replaces a label by its own label, which halves the depth of what is left. Superseded rounds are removed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        lower = labels.select("id", "component").join(near, "id").select("id", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = stored(lower.join(up, "component").select("id", F.least("component", "jump").alias("component"), "old"), "labels")
        discard(labels)
        labels = new
        if not new.filter("component <> old").limit(1).count():
            return new
