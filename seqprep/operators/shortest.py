"""Examples of shortest-path rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions.basics import ints, masked, ones, repeat
from seqprep.functions.draws import Draws
from seqprep.functions.tokens import encode
from seqprep.operators.objectives import reverse_list
from seqprep.options import AUGMENTATIONS, SHORTEST_OBJECTIVES, PrepOptions

# ---- fixed values -------------------------------------------------------------------------
VALIDATION_LENGTH = 50
MAX_FILL = 512  # most end tokens put after the query by augmentation "padding"
# -------------------------------------------------------------------------------------------


def shortest_text(objective: str) -> tuple[Column, Column]:
    """The query and the text to generate for it."""
    if objective not in SHORTEST_OBJECTIVES:
        raise ValueError(f"unknown shortest-path objective: {objective}")
    if objective == "teacherforcing":
        return F.concat("query", F.lit("=")), F.col("target")
    closing = F.concat(F.lit("-"), reverse_list(F.col("target")), F.lit(">="), F.col("target"))
    if objective == "step_eval":
        opening = F.col("steps")
    else:
        opening = F.array_join(
            F.transform("trace", lambda s: F.concat(F.split_part(s, F.lit(","), F.lit(1)), F.lit("($)"))),
            ",",
        )
    return F.concat("query", F.lit("<")), F.concat(opening, closing)


def shortest_examples(
    df: DataFrame, objective: str, opts: PrepOptions, split: str, aug: str = "none"
) -> DataFrame:
    """Query with a begin token, then the generation with an end token.

    Validation rows keep the query apart and bring the generation to a fixed length.
    """
    if aug not in AUGMENTATIONS:
        raise ValueError(f"unknown augmentation: {aug}")
    query, generation = shortest_text(objective)
    eos = opts.vocab.eos_id
    encoded = df.select(
        F.col(opts.row_id),
        F.concat(ints(eos), encode(query, opts.vocab)).alias("_q"),
        F.concat(encode(generation, opts.vocab), ints(eos)).alias("_g"),
    )
    if split != "train":
        cut = F.slice(F.col("_g"), 1, VALIDATION_LENGTH)
        return encoded.select(
            F.col(opts.row_id),
            F.col("_q").alias("input_ids"),
            ones(F.col("_q")).alias("attention_mask"),
            F.concat(cut, repeat(eos, F.lit(VALIDATION_LENGTH) - F.size(cut))).alias("targets"),
        )
    if aug == "padding":
        fill = Draws(opts.seed, F.col(opts.row_id)).below(F.lit(MAX_FILL + 1), "fill")
        encoded = encoded.withColumn("_q", F.concat("_q", repeat(eos, fill)))
    return encoded.select(
        F.col(opts.row_id),
        F.concat("_q", "_g").alias("input_ids"),
        F.concat(masked(F.col("_q")), F.col("_g")).alias("labels"),
    ).select(opts.row_id, "input_ids", ones(F.col("input_ids")).alias("attention_mask"), "labels")
