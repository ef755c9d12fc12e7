"""Connected components of a link table, by alternating stars.

Each round every node hands its larger neighbours to its smallest one, then every node and its smaller
neighbours to their smallest; links only ever point to smaller nodes, and rounds are logarithmic in the
longest path. Every round is a written table, and nothing leaves the executors but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, saved


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """For links (u, v), each v with the smallest of u and its v's: (u, v, m)."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(smallest, "u").select("u", "v", F.least("u", "m").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    small = _to_smallest(large)
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), a link each; root is the component's smallest node, which has no row itself.

    Nulls and links of a node to itself are no links; repeated links count once; no links give no rows.
    """
    now = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(now)
    while True:
        then = saved(_round(now), "links")
        drop(now)
        now, was, seen = then, seen, mark(then)
        if seen == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
