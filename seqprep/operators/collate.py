"""Padding of single rows and of batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions.basics import IGNORE, ones, repeat
from seqprep.operators.ordering import ROWS_PER_RANGE, batched, in_runs, with_batches

STRATEGIES = ("longest", "max_length", "none")


def round_up(length: Column, multiple: int | None) -> Column:
    """``length`` rounded up to a multiple."""
    return F.ceil(length / multiple).cast("int") * multiple if multiple else length


def _fill(array: Column, value: int, missing: Column, side: str) -> Column:
    filler = repeat(value, missing)
    return F.concat(filler, array) if side == "left" else F.concat(array, filler)


def pad(
    df: DataFrame,
    length: Column | int | None = None,
    side: str = "right",
    pad_id: int = 0,
    multiple: int | None = None,
    strategy: str = "max_length",
    token_type_pad_id: int = 0,
) -> DataFrame:
    """Pad ``input_ids`` and the arrays that go with it to one length.

    ``attention_mask`` is filled with 0 (and made of ones when missing), ``labels`` with -1,
    ``token_type_ids`` with its own pad id, ``special_tokens_mask`` with 1. Rows already longer
    stay as they are. Strategy "longest" takes each row's own length, so only ``multiple`` adds
    to it.
    """
    if side not in ("left", "right"):
        raise ValueError(f"invalid padding side: {side}")
    if strategy not in STRATEGIES:
        raise ValueError(f"invalid padding strategy: {strategy}")
    if "attention_mask" not in df.columns:
        df = df.withColumn("attention_mask", ones(F.col("input_ids")))
    if strategy == "none":
        return df
    size = F.size("input_ids")
    if strategy == "longest":
        wanted = size
    elif length is None:
        raise ValueError("strategy max_length needs a length")
    else:
        wanted = F.lit(length) if isinstance(length, int) else length
    missing = round_up(wanted, multiple).cast("int") - size
    fillers = {
        "input_ids": pad_id,
        "attention_mask": 0,
        "labels": IGNORE,
        "token_type_ids": token_type_pad_id,
        "special_tokens_mask": 1,
    }
    return df.select(
        *[
            _fill(F.col(c), fillers[c], missing, side).alias(c) if c in fillers else F.col(c)
            for c in df.columns
        ]
    )


def batch_pad(
    df: DataFrame,
    order_by: str | Sequence[str],
    batch_rows: int,
    side: str = "left",
    pad_id: int = 0,
    multiple: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Pad every row to the longest of its batch; adds ``batch_id``.

    A batch never holds more than ``batch_rows`` rows. Batches and their longest row are found from
    keys and lengths alone; the rows themselves move once at most.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    narrow = df.select(*keys, F.size("input_ids").alias("_len"))
    numbered, ranges = batched(narrow, keys, batch_rows, "_idx", rows_per_range)
    runs = numbered.groupBy("_range", "batch_id").agg(
        F.min(F.struct(*keys)).alias("_key"), F.max("_len").alias("_longest")
    )
    sized = in_runs(df, ranges, runs)
    return pad(sized, F.col("_longest"), side, pad_id, multiple).select(*_with_mask(df), "batch_id")


def _with_mask(df: DataFrame) -> list[str]:
    return df.columns if "attention_mask" in df.columns else [*df.columns, "attention_mask"]


def ragged_batches(
    df: DataFrame,
    order_by: str | Sequence[str],
    batch_rows: int,
    columns: Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Batches whose rows differ in length: ``batch_id, column, min_len, max_len``.

    Only keys and lengths are moved.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    sizes = df.select(*keys, *[F.size(c).alias(f"_n_{c}") for c in columns])
    ends = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(f"_n_{c}").alias("min_len"),
            F.max(f"_n_{c}").alias("max_len"),
        )
        for c in columns
    ]
    per_batch = (
        with_batches(sizes, keys, batch_rows, "_idx", rows_per_range)
        .groupBy("_range", "batch_id")
        .agg(F.array(*ends).alias("_sizes"))
    )
    return per_batch.select("batch_id", F.inline("_sizes")).filter(
        F.col("min_len") < F.col("max_len")
    )
