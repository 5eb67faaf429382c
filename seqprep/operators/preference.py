"""Preference rows: a prompt with a chosen and a rejected answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from seqprep.functions.tokens import split_prompt_target, token_count
from seqprep.operators.ordering import cap


def preference_pairs(df: DataFrame, text: str = "text", drop_equal: bool = False) -> DataFrame:
    """Add ``prompt``, ``chosen`` and ``rejected``; the input columns stay.

    A list of wrong paths gives its first one. ``drop_equal`` leaves out rows whose two answers
    are the same text.
    """
    accepted, _ = split_prompt_target(df, text, "=")
    wrong = F.col("wrong_path")
    if isinstance(df.schema["wrong_path"].dataType, ArrayType):
        wrong = F.get(wrong, 0)
    pairs = accepted.withColumnRenamed("target", "chosen").withColumn("rejected", wrong)
    return pairs.filter(F.col("chosen") != F.col("rejected")) if drop_equal else pairs


def length_budget(pairs: DataFrame, order_by: str, longest: DataFrame) -> DataFrame:
    """One row ``max_length``: tokens of the first prompt plus the longest target.

    ``longest`` is the row of ``objectives.target_lengths``. Both are aggregates; nothing is sorted.
    """
    first = pairs.agg(F.min_by(token_count(F.col("prompt")), F.col(order_by)).alias("n")).scalar()
    return longest.select((first + F.col("max_target_length")).cast("bigint").alias("max_length"))


def preference_max_length(
    pairs: DataFrame, order_by: str | Sequence[str], max_target_len: int
) -> int:
    """The same as a number, with the longest target given; ``order_by`` may be several columns."""
    first = cap(pairs, 1, order_by).select(token_count(F.col("prompt")).alias("n")).first()
    return first["n"] + max_target_len
