"""Connected components of a link table, with DataFrame operations only.

Alternating stars: in a *large star* every node hands its smallest neighbour (or itself) to its larger
neighbours, in a *small star* to its smaller ones.  Each round is two map-side combined minima and two
equi-joins (hot nodes are split by AQE's skew join); rounds needed grow with the logarithm of the longest
path.  The links of every round are written to shared storage, so lineage stays short and nothing is
collected: the driver learns after every round whether every tree is a star, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from migrata.llm.common import discard, stored


def _settled(links: DataFrame) -> bool:
    """True if every node has one link at most and points to a node that points nowhere."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a smaller node in its component; ``root`` is the smallest.

    Roots themselves, and nodes without links, are not listed.  Null and self links are ignored, repeated
    links count once, an empty table gives an empty table.
    """
    x, y = F.col(a), F.col(b)
    now = stored(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    while not _settled(now):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        large = now.join(least, now["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(nearest.select("u", "m")))
        before, now = now, stored(small.distinct(), "links")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
