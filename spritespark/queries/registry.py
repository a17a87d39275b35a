"""Collects queries and their oracles; an oracle may use the projections of FIXTURES by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the projections, each of which may use those before it.
FIXTURES = {
    "pal256": "SELECT idx, (idx*37)%256 AS r, (idx*91)%256 AS g, (idx*151)%256 AS b, CASE WHEN idx = 32 THEN 0 ELSE 255 END AS a FROM range(256) t(idx)",
    "doc_pixels": "SELECT image_id, i%64 AS x, i//64 AS y, unicode(c) AS idx FROM (SELECT doc_id AS image_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents WHERE length(text) > 0)",
    "anim": "SELECT sprite_id, frame, layer, i%32 AS x, i//32 AS y, unicode(c) AS idx FROM (SELECT conv_id AS sprite_id, turn AS frame, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS layer, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM conversations WHERE length(text) > 0)",
    "anim_rgba": "SELECT sprite_id, frame, layer, x, y, idx, (idx*37)%256 AS r, (idx*91)%256 AS g, (idx*151)%256 AS b, CASE WHEN idx = 32 THEN 0 ELSE 255 END AS a FROM anim",
    "emb_gray": "SELECT vec_id AS image_id, label AS sprite_id, p%8 AS x, p//8 AS y, greatest(0, least(255, CAST(floor((CAST(e AS DOUBLE)+1)*127.5) AS BIGINT))) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS p FROM embeddings)",
    "emb_rgba": "SELECT image_id, x, y, v AS r, (v*7)%256 AS g, 255-v AS b, CASE WHEN v%5 = 0 THEN 0 ELSE 255 END AS a FROM emb_gray",
    "frames_tbl": "SELECT conv_id AS sprite_id, turn AS frame, 1 + length(text)%500 AS duration_ms FROM conversations",
    "turns": "SELECT conv_id AS sprite_id, count(*) AS n FROM conversations GROUP BY conv_id",
    "tags_tbl": "SELECT sprite_id, 0 AS tag_id, 0 AS from_frame, n-1 AS to_frame, sprite_id%4 AS dir, sprite_id%3 AS rep FROM turns UNION ALL SELECT sprite_id, 1, 0, n//2, 0, sprite_id%3 FROM turns UNION ALL SELECT sprite_id, 2, n//2, n-1, 1, sprite_id%3 FROM turns",
    "palettes_asof": "SELECT t.sprite_id, f.frame_from, p.idx, q.r, q.g, q.b, q.a FROM turns t, (SELECT unnest([0, 3]) AS frame_from) f, pal256 p JOIN pal256 q ON true WHERE q.idx = (p.idx + t.sprite_id%7 + f.frame_from) % 256",
    "slice_keys": "SELECT sprite_id, f.frame_from, sprite_id%5 AS x, f.frame_from AS y, 8 + f.frame_from AS w, 6 AS h FROM turns, (SELECT unnest([1, 4]) AS frame_from) f",
    "samples": "SELECT l_orderkey AS sheet, l_linenumber AS item, 4 + min(l_partkey)%29 AS w, 4 + min(l_suppkey)%13 AS h FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "layer_tree": "SELECT r_name AS path, 0 AS level, 1000000 + r_regionkey AS layer_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, r_regionkey%5 <> 0 AS visible FROM region UNION ALL SELECT r_name || '/' || n_name, 1, 2000000 + n_nationkey, 1000000 + r_regionkey, n_name, n_nationkey%5 <> 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, 2, 3000000 + s_suppkey, 2000000 + n_nationkey, s_name, s_suppkey%5 <> 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expanded(sql: str) -> str:
    """The oracle with the projections that it uses, directly or through others, as WITH clauses."""
    wanted: set[str] = set()
    texts = [sql]
    while texts:
        text = texts.pop()
        found = {n for n in FIXTURES if re.search(rf"\b{n}\b", text)} - wanted
        wanted |= found
        texts += [FIXTURES[n] for n in found]
    head = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in FIXTURES if n in wanted)
    own = sql.strip()
    if not head:
        return own
    if own.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {own[15:]}"
    return f"WITH {head}, {own[5:]}" if own[:5].upper() == "WITH " else f"WITH {head} {own}"


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers f(spark, sf_dir); whole numbers become BIGINT, as in the oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, k in df.dtypes))

        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = expanded(oracle)
        return f

    return add
