"""Greedy in-order packing of examples into chunks.

Packing starts afresh every ``batch_rows`` rows, so a batch is the unit of the fold: its size is
fixed and no key of the data decides it. The fold sees keys and lengths only; rows with their arrays
are gathered chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions.basics import let, repeat
from seqprep.operators.ordering import ROWS_PER_RANGE, batched, in_runs, with_batches

BATCH_ROWS = 1000
ROWS_PER_WIDE_RANGE = 10_000  # a row looks for its run among those of a range


def chunk_starts(lengths: Column, block_size: int) -> Column:
    """Start position of every chunk for an array of lengths.

    A chunk takes rows while their lengths fit; a row that does not fit opens the next one. A
    first row longer than the block therefore leaves an empty first chunk.
    """
    first = F.struct(
        F.lit(0).cast("bigint").alias("used"),
        F.lit(0).alias("row"),
        F.array(F.lit(0)).alias("starts"),
    )

    def step(state: Column, length: Column) -> Column:
        fits = state["used"] + length <= block_size
        return F.struct(
            F.when(fits, state["used"] + length).otherwise(length).cast("bigint").alias("used"),
            (state["row"] + 1).alias("row"),
            F.when(fits, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["row"])))
            .alias("starts"),
        )

    return F.aggregate(lengths, first, step, lambda s: s["starts"])


def _chunks(
    df: DataFrame,
    order_by: str | Sequence[str],
    length: Column,
    columns: Sequence[str],
    block_size: int,
    batch_rows: int,
    rows_per_range: int,
) -> DataFrame:
    """``batch_id, chunk, rows``: the rows of each chunk as an ordered array of structs."""
    indexed = with_batches(
        df.withColumn("_len", length), order_by, batch_rows, "_idx", rows_per_range
    )
    row = F.struct("_idx", "_len", *columns)
    batches = indexed.groupBy("_range", "batch_id").agg(
        F.sort_array(F.collect_list(row)).alias("_rows")
    )
    starts = chunk_starts(F.col("_rows._len"), block_size)
    cut = batches.select("batch_id", "_rows", starts.alias("_starts")).select(
        "batch_id",
        F.posexplode(
            F.transform(
                "_starts",
                lambda start, c: let(
                    F.coalesce(
                        F.try_element_at(F.col("_starts"), c + 2), F.size("_rows")
                    ),
                    lambda end: F.slice(F.col("_rows"), start + 1, end - start),
                ),
            )
        ).alias("chunk", "rows"),
    )
    return cut


def pack_assign(
    df: DataFrame,
    order_by: str | Sequence[str],
    length: Column,
    block_size: int,
    batch_rows: int = BATCH_ROWS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Chunk of every row: ``order columns, length, batch_id, chunk``. Only lengths are moved."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    narrow = df.select(*keys, length.cast("bigint").alias("length"))
    chunks = _chunks(
        narrow, order_by, F.col("length"), keys, block_size, batch_rows, rows_per_range
    )
    return chunks.select("batch_id", "chunk", F.inline("rows")).select(
        *keys, F.col("_len").alias("length"), "batch_id", "chunk"
    )


def pack(
    df: DataFrame,
    order_by: str | Sequence[str],
    block_size: int,
    columns: Sequence[str] = ("input_ids", "attention_mask", "labels"),
    batch_rows: int = BATCH_ROWS,
    rows_per_range: int = ROWS_PER_WIDE_RANGE,
) -> DataFrame:
    """Packed chunks: ``batch_id, chunk, n_rows`` and the joined arrays.

    The first of ``columns`` decides the length. Nothing is cut or dropped. An attention mask is
    all ones, so it is made again instead of being moved. Chunks are found from keys and lengths
    alone; the rows move once and are grouped by chunk, so that a task gathers one chunk at a time.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    moved = [c for c in columns if c != "attention_mask" or c == columns[0]]
    narrow = df.select(*keys, F.size(columns[0]).alias("_len"))
    numbered, ranges = batched(narrow, keys, batch_rows, "_idx", rows_per_range)
    entry = F.struct("_idx", F.struct(*keys).alias("_key"), "_len")
    batches = numbered.groupBy("_range", "batch_id").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    starts = chunk_starts(F.col("_rows._len"), block_size)
    opened = batches.select(
        "_range", "batch_id", F.col("_rows._key").alias("_keys"), F.posexplode(starts).alias("chunk", "_start")
    )
    runs = opened.select("_range", F.get("_keys", F.col("_start")).alias("_key"), "chunk", "batch_id")
    placed = in_runs(df.select(*_keys(order_by, moved), *moved), ranges, runs)
    row = F.struct(F.struct(*keys).alias("_key"), *moved)
    chunks = placed.groupBy("_range", "batch_id", "chunk").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    joined = {c: F.flatten(F.col(f"_rows.{c}")) for c in moved}
    ids = F.aggregate(F.col(f"_rows.{moved[0]}"), F.lit(0), lambda n, a: n + F.size(a))
    joined.setdefault("attention_mask", repeat(1, ids))
    made = chunks.select("batch_id", "chunk", F.size("_rows").alias("n_rows"), *[joined[c].alias(c) for c in columns])
    # A first row longer than the block leaves an empty chunk before its own.
    types = {c: df.schema[c].dataType for c in moved}
    empty = runs.groupBy("batch_id", "_key").agg(F.min("chunk").alias("chunk"), F.max("chunk").alias("_last"))
    empty = empty.filter(F.col("chunk") < F.col("_last")).select(
        "batch_id", "chunk", F.lit(0).alias("n_rows"),
        *[F.array().cast(types.get(c, "array<int>")).alias(c) for c in columns],
    )
    return made.unionByName(empty)


def _keys(order_by: str | Sequence[str], other: Sequence[str]) -> list[str]:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return [k for k in keys if k not in other]


def chunk_sizes(
    df: DataFrame,
    order_by: str | Sequence[str],
    length: Column,
    block_size: int,
    batch_rows: int = BATCH_ROWS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``batch_id, chunk, n_rows, length`` of every chunk of :func:`pack`, from lengths alone."""
    narrow = df.select(*_keys(order_by, []), length.cast("bigint").alias("length"))
    chunks = _chunks(narrow, order_by, F.col("length"), [], block_size, batch_rows, rows_per_range)
    total = F.aggregate("rows._len", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return chunks.select("batch_id", "chunk", F.size("rows").alias("n_rows"), total.alias("length"))


def pack_fill(packed: DataFrame, block_size: int, length: Column) -> DataFrame:
    """One row: number of chunks, tokens, and the mean share of the block that is filled."""
    tokens = length.cast("bigint")
    return packed.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(tokens).alias("n_tokens"),
        (F.sum(tokens) / F.count(F.lit(1)) / F.lit(block_size)).alias("mean_fill"),
    )
