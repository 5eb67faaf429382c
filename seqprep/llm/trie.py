"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of the first d turns; the conversations that start with it are its
members. The trie is peeled from its deepest level: the nodes of a level are the conversations that
end there, merged with what survives from the level below; then each strips its last turn, and those
with the same remainder are grouped again. All figures of a node are added up while it is found.

Before that every turn gets the digest of the sequence that it ends and of the one before it. A
digest is made from sums over the turns, so it is a running total: taken in pieces of ``PIECE`` turns,
and a conversation of any length meets in no single task. What only one conversation has, the turns
beyond its deepest shared node, is a chain: it needs no grouping, is given out as it stands, and
enters the peeling as one child of that node. So the rounds are as many as the turns of the longest
sequence that two conversations share, each over nodes, not turns.

The digest of the members that end in a node runs over all their ids in order. Ranges of sorted ids
become strings in many tasks; one task for each node reads these strings, one after the other.

Defined cases: messages without a conversation id belong to none and are left out; null roles and
texts are empty; turns are ordered by number, null first, equal numbers by a hash of role and text;
repeated messages are turns of their own; a conversation without turns ends in the root; an empty
table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, numbered, only_cache, small, staged

PIECE = 4096  # turns of a conversation that one window adds up
HEAD = 8  # first turns of a conversation that others may borrow, at most
BROADCAST_NODES = 200_000
FEW_HEAVY = 100_000  # keys whose rows are never shuffled by them
CHUNK_BYTES = 1 << 16  # of a string of ids

CHUNKS = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
_STAT = ["convs", "conv_id", "children", "leaves", "saved"]


def turns_of(messages: DataFrame) -> DataFrame:
    """``conv_id, place, n, what, size``: the turns of each conversation in order, as digests."""
    told = needed(messages, conv_id="conv_id", turn="turn", role="role", text="text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = told.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("what"),
        F.length(text).cast("bigint").alias("size"),
    )
    placed = numbered(turns, ["conv_id"], ["turn", "what"])
    return placed.select("conv_id", "place", F.col("group_rows").alias("n"), "what", "size")


def regrafted(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Put the first ``head`` turns of conversation ``base`` in place of each conversation's own.

    Both are columns of ``conv_id``; ``head`` is ``HEAD`` at most. Gives the turns, ``conv_id, depth,
    what, size``, and the conversations, ``conv_id, total`` (turns).
    """
    convs = turns.filter("place = 0").select("conv_id", "n", base.alias("base"), head.cast("bigint").alias("head"))
    held = turns.filter("place = 0").select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEAD)).alias("held"))
    lent = F.least("head", F.coalesce("held", F.lit(0)))
    known = staged(
        convs.join(held, "base", "left").select(
            "conv_id", "base", "head", "n", lent.alias("lent"),
            (lent + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total"),
        )
    )
    heads = turns.filter(F.col("place") < HEAD).select(F.col("conv_id").alias("base"), "place", "what", "size")
    borrowed = (
        known.filter("lent > 0")
        .select("conv_id", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lent") - 1)).alias("place"))
        .join(heads, ["base", "place"])
        .select("conv_id", (F.col("place") + 1).alias("depth"), "what", "size")
    )
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PIECE))
    spread = known.select("conv_id", "head", "lent", F.explode(pieces).alias("piece"))
    own = (
        turns.withColumn("piece", F.floor(F.col("place") / PIECE))
        .join(spread, ["conv_id", "piece"])
        .filter(F.col("place") >= F.col("head"))
        .select("conv_id", (F.col("lent") + F.col("place") - F.col("head") + 1).alias("depth"), "what", "size")
    )
    return borrowed.unionByName(own), known.select("conv_id", "total")


def _node(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _root() -> Column:
    return _node(F.lit(0), [F.lit(0)] * 4)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, size``: digests of the sequence up to each turn and before it."""
    first, second = (F.xxhash64("what", "depth", F.lit(s)) for s in (1, 2))
    low = F.lit(0xFFFFFFFF)
    terms = [F.shiftright(first, 32), first.bitwiseAND(low), F.shiftright(second, 32), second.bitwiseAND(low)]
    names = [f"_{k}" for k in range(4)]
    cut = turns.withColumn("_piece", F.floor((F.col("depth") - 1) / PIECE))
    cut = cut.withColumns(dict(zip(names, terms)))
    inside = Window.partitionBy("conv_id", "_piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = staged(cut.withColumns({f"{c}s": F.sum(c).over(inside) for c in names}))
    # Pieces but a conversation's last are full: their totals stand at their ends.
    ends = summed.filter(F.col("depth") % PIECE == 0).select(
        "conv_id", (F.col("_piece") + 1).alias("_piece"), *[F.col(f"{c}s") for c in names]
    )
    earlier = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    past = staged(ends.select("conv_id", "_piece", *[F.sum(f"{c}s").over(earlier).alias(f"{c}p") for c in names]))
    past = F.broadcast(past) if small(past, BROADCAST_NODES) else past
    found = summed.join(past, ["conv_id", "_piece"], "left")
    sums = [F.col(f"{c}s") + F.coalesce(f"{c}p", F.lit(0)) for c in names]
    before = [s - F.col(c) for s, c in zip(sums, names)]
    return found.select(
        "conv_id", "depth", _node(F.col("depth"), sums).alias("node"),
        _node(F.col("depth") - 1, before).alias("parent"), "size",
    )


def _looked_up(rows: DataFrame, on: str, known: DataFrame, weight: str) -> DataFrame:
    """``rows`` left-joined to ``known`` (one row a ``node``, whose ``weight`` tells of rows that meet there).

    Rows of the heaviest nodes are joined where they are, only the others are shuffled.
    """
    if small(known, BROADCAST_NODES):
        told = F.broadcast(known.withColumnRenamed("node", on))
        return rows.join(told, on, "left")
    heavy = F.col(weight) >= F.lit(1 + known.agg(F.sum(weight)).first()[0] // FEW_HEAVY)
    few = F.broadcast(known.filter(heavy).withColumnRenamed("node", on))
    rest = rows.join(few.select(on), on, "left_anti")
    light = known.filter(~heavy).withColumnRenamed("node", on)
    return rows.join(few, on).unionByName(rest.join(light, on, "left"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Strings of consecutive ids of a node, from rows sorted by node and id."""
    node, first, held, size = None, 0, [], 0
    for batch in batches:
        for other, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (other != node or size >= CHUNK_BYTES):
                yield node, first, ",".join(held)
                held, size = [], 0
            if not held:
                node, first = other, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield node, first, ",".join(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The digest of each node's strings, joined, which come in order."""
    node, running = None, None
    for batch in batches:
        for other, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
            if running is not None and other == node:
                running.update(b",")
            else:
                if running is not None:
                    yield node, running.hexdigest()
                node, running = other, hashlib.sha256()
            running.update(ids.as_py().encode())
    if running is not None:
        yield node, running.hexdigest()


def ends(members: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ``node, conv_id``: the digest of a node's ids, ascending."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("trie")
        return arrow_rows(CHUNKS, _chunks(batches))

    cut = (
        members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
        .mapInArrow(chunks, "node binary, first bigint, ids string")
    )
    dealt = cut.repartition("node").sortWithinPartitions("node", "first")
    return dealt.mapInArrow(lambda b: arrow_rows(ENDS, _digests(b)), "node binary, ends_sha256 string")


def _merged(parts: DataFrame) -> DataFrame:
    """Nodes of one level: members, children and leaves added up; ``parent`` and ``size`` from the edge."""
    found = parts.groupBy("node").agg(
        F.sum("convs").alias("convs"), F.min("conv_id").alias("conv_id"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("parent").alias("parent"), F.max("size").alias("size"),
    )
    return found.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves"))).withColumn(
        "saved", F.col("saved") + (F.col("convs") - 1) * F.col("size")
    )


def peeled(starts: DataFrame, edges: DataFrame, deepest: int) -> DataFrame:
    """All shared nodes, from the deepest level to the root.

    ``starts`` has one row for each node where conversations come in: ``depth, node, convs, conv_id,
    children, leaves, saved``; ``edges`` has ``depth, node, parent, size`` of every shared node but the root.
    """
    nothing = {c: F.lit(0).cast("bigint") for c in _STAT if c != "conv_id"} | {"conv_id": F.lit(None).cast("bigint")}
    edge = edges.select("depth", "node", "parent", "size", *[c.alias(n) for n, c in nothing.items()])
    start = starts.select(
        "depth", "node", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("size"), *_STAT
    )
    come = start.unionByName(edge)
    levels: list[DataFrame] = []
    alive = None
    for depth in range(deepest, -1, -1):
        here = come.filter(F.col("depth") == depth).drop("depth")
        here = here if alive is None else here.unionByName(alive)
        level = staged(_merged(here))
        levels.append(level.withColumn("depth", F.lit(depth).cast("bigint")))
        alive = level.select(  # the last turn stripped: each is one child of what remains
            F.col("parent").alias("node"), F.lit(None).cast("binary").alias("parent"),
            F.lit(0).cast("bigint").alias("size"), "convs", "conv_id",
            F.lit(1).cast("bigint").alias("children"), "leaves", "saved",
        )
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (``conv_id, depth, what, size``) and ``convs`` (``conv_id, total``).

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    rows = staged(prefixes(turns))
    edges = staged(
        rows.groupBy("node")
        .agg(
            F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("size").alias("size"),
            F.count(F.lit(1)).alias("weight"),
        )
        .filter("weight > 1")
    )
    shared = edges.select("node", "weight", F.lit(True).alias("shared"))
    marked = staged(_looked_up(rows.drop("size"), "node", shared, "weight").drop("weight"))
    last = marked.filter("shared").groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("at"))
    entered = staged(
        convs.join(last, "conv_id", "left").select(
            "conv_id", "total", F.coalesce("at.depth", F.lit(0)).alias("depth"), F.coalesce("at.node", _root()).alias("node")
        )
    )
    tail = (F.col("total") > F.col("depth")).cast("bigint")
    starts = staged(
        entered.groupBy("depth", "node").agg(
            F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("conv_id"),
            F.sum(tail).alias("children"), F.sum(tail).alias("leaves"), F.lit(0).cast("bigint").alias("saved"),
        )
    )
    deepest = starts.agg(F.max("depth")).first()[0]
    nodes = staged(peeled(starts, edges.drop("weight"), deepest or 0))
    told = nodes.select("node", F.col("conv_id").alias("parent_conv_id"), "children")
    none = F.sha2(F.lit(""), 256)
    ended = ends(entered.filter("total = depth").select("node", "conv_id"))
    found = _looked_up(nodes.withColumnRenamed("children", "n_children"), "parent", told, "children").join(
        ended, "node", "left"
    )
    common = found.select(
        "conv_id", "depth", "parent_conv_id", F.col("convs").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    # Chains that one conversation has for itself. The last turn is told by the conversation's total.
    alone = marked.filter("shared is null").drop("shared")
    lasts = entered.filter("total > depth").select("conv_id", F.col("total").alias("depth"), F.lit(True).alias("last"))
    chain = _looked_up(alone, "parent", told, "children").join(lasts, ["conv_id", "depth"], "left")
    one = F.lit(1).cast("bigint")
    chains = chain.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return common.unionByName(chains)
