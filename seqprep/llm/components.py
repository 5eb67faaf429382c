"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import Rounds


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Here v < u in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("v < u").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of the links ``u, v`` with the smallest node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes; each round is
    written to the shared folder, so lineage stays short. Links may repeat or be loops.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    rounds = Rounds(edges.sparkSession)
    now = rounds.staged(edges.filter("u != v").select(u.alias("u"), v.alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen[0] == 0 or seen == state:
            break
        state = seen
        now = rounds.staged(_small_star(_large_star(now).distinct()).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
