"""Merkle manifest of a dataset, with checkpointed levels and recomputed proofs.

Every document is a leaf. The leaves of a source, ascending by doc_id, are one tree: 16 nodes in a
row become one, until one is left, the subroot. The subroots, in the order of their sources, are the
leaves of the top tree, whose last node is the root.

Only every ``STRIDE``-th level is written. The nodes below one written node are an aligned subtree of
at most 16 ** ``STRIDE`` written nodes; what lies between is made again wherever it is needed:

    building  a subtree gives the written node above it
    proving   a subtree, with the path of the node above it, gives the path of each of its nodes

So paths are made from the top down, each level's from the one above, and nodes between written
levels live inside one expression only. A path is an array of ``left`` and ``right``: the joined
siblings on both sides, level by level up to the root.

A leaf's place in its source comes from a range sort and counts for each range, so a source of any
size meets in no single task; after that every group has a fixed size.

Defined cases: null values have their own mark in a leaf; sources may be null (first in order, a
source of its own); documents of a source with the same doc_id, or none (first), stand in the order
of their leaves, equal ones in any; a lone leaf is its source's subroot, a lone subroot the root; an
empty table has no rows, no proofs and no root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.functions.basics import let
from seqprep.llm.common import numbered, small, staged

FANOUT_BITS = 4  # 16 nodes become one
STRIDE = 2  # levels between written ones
TREES = 100_000  # source trees whose upper paths are broadcast; more of them are joined by a shuffle
FANOUT = 1 << FANOUT_BITS
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields: each its length in bytes and its value, or a mark when it is null."""
    told = [f.cast("string") for f in fields]
    return digest(
        F.concat(
            *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told]
        )
    )


def _above(nodes: Column) -> Column:
    """The nodes of the next level."""
    last = F.shiftright(F.size(nodes) - 1, FANOUT_BITS)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda run: digest(F.array_join(F.slice(nodes, run * FANOUT + 1, F.lit(FANOUT)), "")),
    )


def _top(nodes: Column, steps: Column, made: int = 0) -> Column:
    """The node ``steps`` levels above a whole subtree."""
    if made == STRIDE:
        return nodes[0]
    higher = let(_above(nodes), lambda up: _top(up, steps, made + 1))
    return F.when(steps == made, nodes[0]).otherwise(higher)


def _side(nodes: Column, at: Column) -> Column:
    """Siblings left and right of the node at a place, in its run of 16."""
    inside = at.bitwiseAND(FANOUT - 1)
    return F.struct(
        F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("left"),
        F.array_join(F.slice(nodes, at + 2, FANOUT - 1 - inside), "").alias("right"),
    )


def _paths(levels: list[Column], steps: Column, above: Column) -> Column:
    """Path of every node of a subtree; ``above`` is the path of the node over it."""
    if len(levels) < STRIDE:
        up = F.when(steps > len(levels), _above(levels[-1])).otherwise(F.slice(levels[-1], 1, 0))
        return let(up, lambda nodes: _paths([*levels, nodes], steps, above))

    def path(_: Column, at: Column) -> Column:
        sides = [
            F.when(steps > j, F.array(_side(nodes, F.shiftright(at, j * FANOUT_BITS))))
            .otherwise(F.array())
            .cast(PATH)
            for j, nodes in enumerate(levels)
        ]
        return F.concat(*sides, above)

    return F.transform(levels[0], path)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum((n > (1 << (FANOUT_BITS * j))).cast("int") for j in range(15))


def _subtrees(nodes: DataFrame, level: int, kept: Sequence[str] = ()) -> DataFrame:
    """``tree, above, height, steps, members``: written nodes below one node of the next written level."""
    return (
        nodes.groupBy("tree", F.shiftright("idx", FANOUT_BITS * STRIDE).alias("above"), "height")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "node", *kept))).alias("members"))
        .withColumn("steps", F.least(F.col("height") - level, F.lit(STRIDE)))
    )


def _levels(highest: int | None) -> range:
    return range(0, max(highest or 0, 1), STRIDE)


def _build(nodes: DataFrame, path: str) -> DataFrame:
    """Write every ``STRIDE``-th level of the trees of ``nodes`` (``tree, idx, height, node, ...``).

    Gives the last node of each tree: ``tree, node``.
    """
    spark = nodes.sparkSession
    nodes.write.parquet(f"{path}/level-0")
    read = spark.read.schema(nodes.schema).parquet(f"{path}/level-0")
    roots = []
    for level in _levels(read.agg(F.max("height")).first()[0]):
        if level:
            read = spark.read.parquet(f"{path}/level-{level}")
        tops = _subtrees(read, level).select(
            "tree", F.col("above").alias("idx"), "height",
            let(F.col("members.node"), lambda nodes: _top(nodes, F.col("steps"))).alias("node"),
        )
        tops.write.parquet(f"{path}/level-{level + STRIDE}")
        made = spark.read.schema(tops.schema).parquet(f"{path}/level-{level + STRIDE}")
        roots.append(
            made.filter((F.col("height") <= level + STRIDE) & ((F.col("height") > level) | F.lit(level == 0)))
        )
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return found.select("tree", "node")


def _proved(spark: SparkSession, path: str, above: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Written leaves with their path; ``above`` has ``tree, height, path, subroot`` of every tree."""
    leaves = spark.read.parquet(f"{path}/level-0")
    highest = leaves.agg(F.max("height")).first()[0]
    over, found = None, None
    for level in reversed(_levels(highest)):
        read = leaves if level == 0 else spark.read.parquet(f"{path}/level-{level}")
        more = kept if level == 0 else ()
        starts = (F.col("height") > level) if level else F.lit(True)
        top = above.filter((F.col("height") <= level + STRIDE) & starts).select(
            "tree", F.lit(0).cast("bigint").alias("above"), "path", "subroot"
        )
        over = top if over is None else over.unionByName(top)
        # Trees that end below this level have their last node written here too: they have no subtree.
        trees = _subtrees(read.filter(starts), level, more).join(over, ["tree", "above"])
        paths = let(F.col("members.node"), lambda nodes: _paths([nodes], F.col("steps"), F.col("path")))
        found = trees.select(
            "tree", "subroot", F.inline(F.arrays_zip("members", paths.alias("path")))
        ).select("tree", "subroot", "path", F.col("members.idx").alias("idx"), "members.node",
                 *[F.col(f"members.{c}").alias(c) for c in more])
        over = found.select("tree", F.col("idx").alias("above"), "path", "subroot")
    return found


def write_manifest(rows: DataFrame, path: str, kept: Sequence[str] = ()) -> None:
    """Write the manifest of ``rows`` (``source, doc_id, leaf`` and the columns ``kept``) to ``path``."""
    placed = staged(numbered(rows.select("source", "doc_id", "leaf", *kept), ["source"], ["doc_id", "leaf"]))
    sources = placed.filter("place = 0").select("source", F.col("group_rows").alias("n"))
    sources = sources.withColumn("all", F.lit(0))
    trees = staged(numbered(sources, ["all"], ["source"]).withColumnRenamed("place", "tree"))
    named = trees.select(F.col("source").alias("_source"), "tree", "n")
    named = F.broadcast(named) if small(trees, TREES) else named
    leaves = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", F.col("place").alias("idx"), _height(F.col("n")).alias("height"),
        F.col("leaf").alias("node"), "doc_id", *kept,
    )
    subroots = _build(leaves, f"{path}/sources")
    heights = trees.select(
        "tree", "source", _height(F.col("n")).alias("own_height"), _height(F.col("group_rows")).alias("height")
    )
    top = subroots.join(heights, "tree").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "height", "node", "source", "own_height"
    )
    _build(top, f"{path}/top").write.parquet(f"{path}/root")


def root(spark: SparkSession, path: str) -> str | None:
    """The root of a manifest; none of an empty one."""
    found = spark.read.parquet(f"{path}/root").first()
    return found and found["node"]


def proofs(spark: SparkSession, path: str, kept: Sequence[str] = ()) -> DataFrame:
    """Every document: ``doc_id, leaf, subroot, path`` and the columns ``kept`` when it was written."""
    heights = spark.read.parquet(f"{path}/top/level-0").agg(F.max("height")).first()[0]
    start = spark.createDataFrame([(0, heights or 0, [], "")], f"tree bigint, height int, path {PATH}, subroot string")
    top = _proved(spark, f"{path}/top", start, ["own_height"])
    above = staged(
        top.select(F.col("idx").alias("tree"), F.col("own_height").alias("height"), "path", F.col("node").alias("subroot"))
    )
    above = F.broadcast(above) if small(above, TREES) else above
    found = _proved(spark, f"{path}/sources", above, ["doc_id", *kept])
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", "path", *kept)


def proof_text(path: Column) -> Column:
    """All siblings of a path in one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda held, s: digest(F.concat(s["left"], held, s["right"])))
