"""Examples of signed-variable chains ("lego" rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions.basics import ints, masked, ones
from seqprep.functions.draws import Draws
from seqprep.functions.tokens import (
    Vocab,
    encode,
    encode_tokens,
    node_set,
    split_parts,
    split_prompt_target,
    vocab_of,
)
from seqprep.operators.objectives import replace_inner
from seqprep.options import LEGO_TASKS, PrepOptions

LEGO_TEXT = "symbol_text"
TASK_COLUMNS = {"steps": "target_steps", "direct": "target_direct", "path": "target_path"}


def lego_task(df: DataFrame, task: str, text: str = LEGO_TEXT) -> DataFrame:
    """Set ``prompt`` and ``target`` for a task; lines without exactly one ``?`` are left out.

    "verify_steps" moves the proposed solution into the prompt and asks for the verdict.
    """
    if task not in LEGO_TASKS:
        raise ValueError(f"unknown task: {task}")
    accepted, _ = split_prompt_target(df, text, "?")
    if task != "verify_steps":
        told = accepted.withColumn("target", F.col(TASK_COLUMNS[task]))
        return told.filter(F.col("target").isNotNull())
    checked = accepted.withColumn("_v", F.split("target_verify", "[?]", -1))
    return (
        checked.filter(F.size("_v") == 2)
        .withColumn("prompt", F.concat(F.col("prompt"), F.get("_v", 0), F.lit("?")))
        .withColumn("target", F.get("_v", 1))
        .drop("_v")
    )


def lego_rejected(
    df: DataFrame, task: str, row_id: str = "id", text: str = LEGO_TEXT
) -> DataFrame:
    """Rows :func:`lego_task` leaves out, as ``row id, reason``."""
    accepted, rejects = split_prompt_target(df, text, "?")
    column = TASK_COLUMNS.get(task, "target_verify")
    bad = F.col(column).isNull()
    if task == "verify_steps":
        bad = bad | (F.size(F.split(column, "[?]", -1)) != 2)
    return rejects.select(row_id, F.lit("parts").alias("reason")).unionByName(
        accepted.filter(bad).select(row_id, F.lit("target").alias("reason"))
    )


def _assemble(encoded: DataFrame, row_id: str, split: str, given: Column) -> DataFrame:
    """Train: prompt and target in one sequence, loss on the target. Validation: two columns."""
    if split != "train":
        return encoded.select(
            F.col(row_id),
            F.col("_p").alias("input_ids"),
            ones(F.col("_p")).alias("attention_mask"),
            F.col("_t").alias("targets"),
        )
    return encoded.select(
        F.col(row_id),
        F.concat("_p", given).alias("input_ids"),
        F.concat(masked(F.col("_p")), F.col("_t")).alias("labels"),
    ).select(row_id, "input_ids", ones(F.col("input_ids")).alias("attention_mask"), "labels")


def _noisy(nodes: Column, opts: PrepOptions) -> Column:
    draws = Draws(opts.seed, F.col(opts.row_id))
    noisy = replace_inner(F.col("_t"), draws, nodes)
    hit = draws.uniform("gate") < F.lit(float(opts.noisy_target))
    return F.when(hit, noisy).otherwise(F.col("_t"))


def _symbols(vocab: Vocab, text: str) -> Column:
    return ints(*[vocab.id_of(s) for s in text])


def lego_examples(
    df: DataFrame, task: str, objective: str, opts: PrepOptions, split: str
) -> DataFrame:
    """Lego examples without end token or padding.

    Objective "noisytarget" replaces the inner input tokens: by nodes of the prompt for task
    "path", by a sign for "steps". The other tasks do not allow it.
    """
    if objective == "noisytarget" and task in ("direct", "verify_steps"):
        raise ValueError(f"target noise is not defined for task {task}")
    vocab = vocab_of("lego")
    encoded = lego_task(df, task).select(
        F.col(opts.row_id),
        encode(F.col("prompt"), vocab).alias("_p"),
        encode(F.col("target"), vocab).alias("_t"),
    )
    given = F.col("_t")
    if objective == "noisytarget":
        nodes = node_set(F.col("_p"), vocab.nodes) if task == "path" else _symbols(vocab, "-+")
        given = _noisy(nodes, opts)
    return _assemble(encoded, opts.row_id, split, given)


def lego_extract(
    df: DataFrame, opts: PrepOptions, split: str = "train", text: str = "text"
) -> DataFrame:
    """Examples whose target is read off the line itself.

    The target is the third character after the first ``/`` of the prompt, then the
    next-to-last character of every ``:``-separated step. Lines too short for that are left out.
    """
    vocab = vocab_of("lego")
    parts = split_parts(F.col(text), "?")
    steps = F.split(F.get("_parts", 1), ":", -1)
    start = F.substring(F.try_element_at(F.split(F.get("_parts", 0), "/", -1), F.lit(2)), 3, 1)
    signs = F.transform(steps, lambda s: F.substring(s, F.length(s) - 1, F.lit(1)))
    rows = (
        df.withColumn("_parts", parts)
        .filter(F.size("_parts") == 2)
        .filter((F.length(start) == 1) & F.forall(steps, lambda s: F.length(s) >= 2))
    )
    encoded = rows.select(
        F.col(opts.row_id),
        encode(F.concat(F.get("_parts", 0), F.lit("?")), vocab).alias("_p"),
        encode_tokens(F.concat(F.array(start), signs), vocab).alias("_t"),
    )
    given = F.col("_t")
    if opts.noisy_target > 0:
        given = _noisy(node_set(F.col("_p"), vocab.nodes), opts)
    return _assemble(encoded, opts.row_id, split, given)
