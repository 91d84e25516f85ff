"""Connected components by alternating large-star and small-star steps.

Edges stay distributed: each step is one aggregation and one join, its result is written to the
shared checkpoint folder, and the driver sees only a count and a checksum. A node with very many
edges costs one row of the aggregation (pre-aggregated before the shuffle) and a join that
adaptive execution can split, never one large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) edges with u > v; returns such edges again."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        made = near.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        made = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node reachable.

    ``links`` has two columns of one orderable type. Null ends and self-links are left out,
    repeated and reversed links count once. No links: no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = cut_lineage(edges.distinct())
    state, rows = None, edges.count()
    for _ in range(max_rounds if rows else 0):
        edges = cut_lineage(_star(_star(edges, large=True), large=False), rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, rows = now, now[0]
    else:
        if rows:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
