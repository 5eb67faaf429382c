"""Sharding by Karmarkar-Karp differencing: near equal bytes, groups of equal texts undivided.

Documents with the same text (a null one counts as empty) go together. Groups as large as a share of
a shard are items of their own, at most ``n_shards * FINE`` of them; all others are bundled by a
hash, so the number of items is bounded however many documents there are. One task then differences
the items: partial partitions are combined, the two with the largest spread first, largest part with
smallest, until one is left. Documents get their shard by joining their item, a broadcast of bounded
size, and their slot from counts per shard and range of ids.

Defined cases: the size is the bytes of the text plus 1, so 1 for a null or empty text; repeated rows
count as often as they stand and get slots of their own; ties are broken by item number; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqprep.llm.common import needed, pieces_of, staged

BUNDLES = 16_384
FINE = 64  # a group is an item of its own from 1/64 of a shard's mean on
SLOT_ROWS = 100_000  # rows numbered by one task


def karmarkar_karp(sizes: Sequence[int], k: int) -> np.ndarray:
    """Part (0 to k - 1) of each item.

    A partial partition is k sums in ascending order, its parts as linked lists of items. Combining
    two adds the largest part of one to the smallest of the other, and so on.
    """
    n = len(sizes)
    part = np.zeros(n, dtype=np.int64)
    if n == 0:
        return part
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        sums = [0] * (k - 1) + [int(size)]
        heap.append((-(sums[-1] - sums[0]), i, sums, [None] * (k - 1) + [(i, None, None)]))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, a_parts = heapq.heappop(heap)
        _, _, b, b_parts = heapq.heappop(heap)
        joined = []
        for i in range(k):
            x, y = a_parts[i], b_parts[k - 1 - i]
            joined.append((a[i] + b[k - 1 - i], i, y if x is None else x if y is None else (None, x, y)))
        joined.sort(key=lambda j: j[:2])
        sums = [j[0] for j in joined]
        heapq.heappush(heap, (-(sums[-1] - sums[0]), number, sums, [j[2] for j in joined]))
        number += 1
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree] if tree is not None else []
        while stack:
            item, x, y = stack.pop()
            if item is not None:
                part[item] = shard
            else:
                stack += [x, y]
    return part


def _slots(df: DataFrame, n_rows: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, by a fixed order that no single task sorts."""
    ranges = pieces_of(n_rows, SLOT_ROWS)
    piece = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(ranges))  # equal rows part
    cut = df.withColumn("_piece", piece)
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size")
    return (
        cut.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_piece"])
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_piece", "_place", "_start", "row")
    )


def shard_by_bytes(
    df: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", bundles: int = BUNDLES
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document. Texts are read once."""
    whole = F.coalesce("text", F.lit(""))
    docs = staged(
        needed(df, doc_id=doc_id, text=text).select(
            "doc_id",
            (F.octet_length(whole) + 1).cast("bigint").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.xxhash64(whole).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = docs.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    groups = docs.groupBy("group").agg(F.sum("size").alias("bytes"))
    own = F.col("bytes") * F.lit(n_shards * FINE) >= F.lit(total["bytes"] or 1)
    large = staged(groups.filter(own))  # at most n_shards * FINE rows
    few = F.broadcast(large.select("group", F.lit(True).alias("large")))
    item = F.when(F.col("large"), F.struct(F.lit(1).alias("kind"), F.col("group").alias("id"))).otherwise(
        F.struct(F.lit(0).alias("kind"), F.pmod("group", F.lit(bundles)).alias("id"))
    )
    placed = docs.join(few, "group", "left").withColumn("item", item).drop("group", "large")

    def difference(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "kind", "id"], ascending=[False, True, True])
        items["shard"] = karmarkar_karp(items["bytes"].tolist(), n_shards)
        return items[["kind", "id", "shard"]]

    items = placed.groupBy("item.kind", "item.id").agg(F.sum("size").alias("bytes"))
    shards = items.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda rows: difference(rows), "kind int, id bigint, shard int"
    )
    shards = F.broadcast(staged(shards).select(F.struct("kind", "id").alias("item"), "shard"))
    return _slots(placed.join(shards, "item").drop("item"), total["n"])
