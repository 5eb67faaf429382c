"""Whole preparation and scoring jobs.

Each job loads and splits the raw table, builds the examples of both splits, packs or caps them
and writes each split once; raw and written rows are counted while they are written. With the option
``streaming`` the same job reads its source as a stream and builds its micro-batches. The folder is
named by the job, the options, all other parameters and the input's files; a second run of the same
reads what is there, before it loads or builds anything. Tables handed over as ``raw`` have no files:
give a name as ``source``, or they are built anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqprep.functions.basics import let
from seqprep.functions.tokens import Vocab, decode, vocab_kind_for, vocab_of
from seqprep.functions.vectors import log_sum_exp, softmax, tail_slice, token_prob, topk_tokens
from seqprep.operators.lego import lego_examples
from seqprep.operators.metrics import eval_metrics
from seqprep.operators.objectives import examples, max_target_length
from seqprep.operators.ordering import cap, cap_filter, sample_rows
from seqprep.operators.packing import pack
from seqprep.operators.preference import preference_max_length, preference_pairs
from seqprep.operators.shortest import shortest_examples
from seqprep.options import PrepOptions, block_size, validate_options
from seqprep.sources.files import (
    SPLITS, content_of, exists, finished, load_raw, remove, save_metrics, scratch_scope, staged,
)
from seqprep.streaming.streams import stream_raw, write_epochs

Splits = dict[str, DataFrame]
Make = Callable[[DataFrame], DataFrame]


class Prepared(dict):
    """The written splits by name, with their counts: ``split, n_rows`` (raw) and ``n_kept`` (written)."""

    def __init__(self, parts: Splits, counts: DataFrame):
        super().__init__(parts)
        self.counts = counts

    def samples(self, opts: PrepOptions, vocab: Vocab | None = None, n: int = 3) -> DataFrame:
        """``n`` written training rows: their key and the text of ``input_ids``."""
        train = self["train"]
        keys = [opts.row_id] if opts.row_id in train.columns else ["batch_id", "chunk"]
        told = train.withColumn("_key", F.concat_ws("/", *keys))
        picked = sample_rows(told.select(*keys, "_key", "input_ids"), "_key", n, opts.seed)
        return picked.select(*keys, decode(F.col("input_ids"), vocab or opts.vocab).alias("text"))


def _folder(
    spark: SparkSession, opts: PrepOptions, out: str, job: str, raw: Splits | None, source: str | None, **more: object
) -> str:
    """Where a job's tables go: its name and a digest of all that decides them, the input's files too."""
    if raw is None:
        source = content_of(spark, opts)
    source = source or uuid.uuid4().hex
    told = json.dumps([job, opts.fingerprint(), source, more], sort_keys=True)
    return f"{out}/{job}-{hashlib.md5(told.encode()).hexdigest()[:16]}"


def _there(spark: SparkSession, folder: str, opts: PrepOptions) -> Prepared | None:
    """The finished tables of an earlier run, unless they are to be written again."""
    if opts.overwrite_cache or not finished(spark, f"{folder}/counts"):
        return None
    return Prepared({s: _read(spark, f"{folder}/{s}") for s in SPLITS}, spark.read.parquet(f"{folder}/counts"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("epoch")  # the folder of a micro-batch


def _loaded(spark: SparkSession, opts: PrepOptions, raw: Splits | None) -> Splits:
    """The raw splits; rows without an id get their place in the files as one."""
    return raw or load_raw(spark, opts, opts.row_id)


def _observed(seen: Observation, df: DataFrame) -> int:
    """The rows counted while they were written; counted now where the optimiser left them all out."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return df.count()


def _write(rows: DataFrame, folder: str, make: Make, chunked: Make | None) -> tuple[int, int]:
    """Build a split, or a micro-batch of it, and write it. Counts it on the way: raw rows and written ones."""
    raw, kept = Observation(), Observation()
    made = make(rows.observe(raw, F.count(F.lit(1)).alias("n")))
    if chunked is not None:  # reads its rows several times
        made = chunked(staged(made))
    made.observe(kept, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(folder)
    return _observed(raw, rows), _observed(kept, rows.sparkSession.read.parquet(folder))


def _written(
    spark: SparkSession,
    opts: PrepOptions,
    folder: str,
    raw: Splits | None,
    job: Callable[[Splits], Callable[[str], Make]],
    chunked: Make | None = None,
) -> Prepared:
    """Run a job on its source, as a batch or as a stream.

    ``job`` looks at the raw splits and gives the function that builds one of them; ``chunked`` packs
    built training rows. A stream builds its micro-batches by the same functions, each into a folder of
    its own, with a checkpoint; those of a job that failed are gone on with.
    """
    if raw is not None and opts.streaming:
        raise ValueError("a streaming job reads the source that its options name")
    with scratch_scope(spark):
        parts = _loaded(spark, opts, raw)
        build = job(parts)
        limits = {"train": opts.max_train_samples, "validation": opts.max_eval_samples}
        streams = stream_raw(spark, opts) if opts.streaming else {}
        counts = []
        for name, part in parts.items():
            make, pack_rows = build(name), chunked if name == "train" else None
            limit = limits[name]
            if limit is not None and pack_rows is None:
                inside = cap_filter(make(part), limit, opts.row_id)
                make = _then(make, inside)
            path = f"{folder}/{name}"
            if limit is not None and pack_rows is not None:
                path = f"{folder}/_chunks"  # they can be counted only once there are all of them
            if opts.streaming:
                n = _streamed(streams[name], path, f"{folder}/_state/{name}", make, pack_rows, opts.overwrite_cache)
            else:
                n = _write(part, path, make, pack_rows)
            if limit is not None and pack_rows is not None:
                chunks = spark.read.parquet(path)
                first = ["epoch"] if opts.streaming else []
                cap(chunks, limit, [*first, "batch_id", "chunk"]).drop("epoch").write.mode("overwrite").parquet(
                    f"{folder}/{name}"
                )
                remove(spark, path)
                n = n[0], spark.read.parquet(f"{folder}/{name}").count()
            counts.append((name, *n))
    told = spark.createDataFrame(counts, "split string, n_rows bigint, n_kept bigint")
    told.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts")
    return Prepared({s: _read(spark, f"{folder}/{s}") for s in SPLITS}, spark.read.parquet(f"{folder}/counts"))


def _then(make: Make, inside: Column) -> Make:
    return lambda rows: make(rows).filter(inside)


def _streamed(
    rows: DataFrame, path: str, state: str, make: Make, chunked: Make | None, anew: bool
) -> tuple[int, int]:
    """Write a stream until its present input is used up. Gives the rows read and written."""
    spark = rows.sparkSession
    if anew:
        remove(spark, path)
        remove(spark, state)

    def write(batch: DataFrame, folder: str) -> None:
        raw, kept = _write(batch, folder, make, chunked)
        told = batch.sparkSession.createDataFrame([(raw, kept)], "n_rows bigint, n_kept bigint")
        told.coalesce(1).write.mode("overwrite").parquet(f"{state}/counts/{folder.rsplit('/', 1)[1]}")

    write_epochs(rows, path, f"{state}/checkpoint", write).awaitTermination()
    if not exists(spark, f"{state}/counts"):  # no row ever came: the tables are still there, empty
        nothing = spark.createDataFrame([], rows.schema)
        write(nothing, f"{path}/epoch=0")
    found = spark.read.parquet(f"{state}/counts").agg(F.sum("n_rows"), F.sum("n_kept")).first()
    return found[0], found[1]


def prepare_star(
    spark: SparkSession,
    opts: PrepOptions,
    out: str,
    raw: Splits | None = None,
    source: str | None = None,
) -> Prepared:
    """Path-finding examples of both splits, capped but not packed."""
    validate_options(opts)
    folder = _folder(spark, opts, out, "star", raw, source)
    if there := _there(spark, folder, opts):
        return there

    def job(parts: Splits) -> Callable[[str], Make]:
        longest = max_target_length(*parts.values())
        return lambda name: lambda rows: examples(rows, opts.objective, opts, name, longest)

    return _written(spark, opts, folder, raw, job)


def prepare_lego(
    spark: SparkSession,
    opts: PrepOptions,
    out: str,
    raw: Splits | None = None,
    source: str | None = None,
) -> Prepared:
    """Signed-variable chain examples of both splits, capped but not packed."""
    validate_options(opts)
    folder = _folder(spark, opts, out, "lego", raw, source)
    if there := _there(spark, folder, opts):
        return there

    def job(parts: Splits) -> Callable[[str], Make]:
        return lambda name: lambda rows: lego_examples(rows, opts.task, opts.objective, opts, name)

    return _written(spark, opts, folder, raw, job)


def prepare_shortest(
    spark: SparkSession,
    opts: PrepOptions,
    out: str,
    tokenizer_max: int,
    position_limit: int | None = None,
    raw: Splits | None = None,
    source: str | None = None,
) -> Prepared:
    """Shortest-path examples: train rows packed, validation rows as they are.

    The cap on training rows counts packed chunks, so it cannot be applied before packing. A stream
    packs each micro-batch on its own.
    """
    validate_options(opts)
    block = block_size(opts.block_size, tokenizer_max, position_limit)
    folder = _folder(spark, opts, out, "shortest", raw, source, block=block)
    if there := _there(spark, folder, opts):
        return there

    def job(parts: Splits) -> Callable[[str], Make]:
        return lambda name: lambda rows: shortest_examples(rows, opts.objective, opts, name, opts.aug)

    return _written(spark, opts, folder, raw, job, lambda made: pack(made, opts.row_id, block))


def prepare(
    spark: SparkSession,
    opts: PrepOptions,
    out: str,
    tokenizer_max: int = 2048,
    position_limit: int | None = None,
    raw: Splits | None = None,
    source: str | None = None,
) -> Prepared:
    """Choose the job by dataset name, as the vocabulary is chosen."""
    kind = vocab_kind_for(opts.dataset_name or opts.train_file or opts.validation_file)
    if kind == "lego":
        return prepare_lego(spark, opts, out, raw, source)
    return prepare_shortest(spark, opts, out, tokenizer_max, position_limit, raw, source)


@dataclass(frozen=True)
class PreferenceData:
    pairs: Prepared
    max_length: int


def prepare_preference(
    spark: SparkSession,
    opts: PrepOptions,
    out: str,
    raw: Splits | None = None,
    drop_equal: bool = False,
    source: str | None = None,
) -> PreferenceData:
    """Preference rows of both splits and the length budget of a prompt with its answer."""
    validate_options(opts)
    folder = _folder(spark, opts, out, "preference", raw, source, drop_equal=drop_equal)
    pairs = _there(spark, folder, opts)
    if pairs is None:
        uncapped = replace(opts, max_train_samples=None, max_eval_samples=None)

        def job(parts: Splits) -> Callable[[str], Make]:
            return lambda name: lambda rows: preference_pairs(rows, opts.text_column, drop_equal)

        pairs = _written(spark, uncapped, folder, raw, job)
    longest = max_target_length(*pairs.values())
    return PreferenceData(pairs, preference_max_length(pairs["train"], opts.row_id, longest))


def score(predictions: DataFrame, kind: str, out: str, num_nodes: int = 50) -> DataFrame:
    """Sequence and token accuracy of a table of predictions, saved as JSON."""
    metrics = eval_metrics(predictions, vocab_of(kind, num_nodes).eos_id)
    save_metrics(metrics, out)
    return predictions.sparkSession.read.schema(metrics.schema).json(out)


def scored_outputs(outputs: DataFrame, row_id: str = "id", k: int = 3) -> DataFrame:
    """``row id, preds, labels, probs, best, label_prob`` of every generated sequence, in one projection.

    ``outputs`` holds ``row id, sequence, labels`` and the logits: ``logits``, a vector for each answered
    position, or only ``first``, that of the first one. ``preds`` is the answer cut off the end of the
    sequence, ``probs`` the probability of each of its tokens, ``best`` the ``k`` likeliest first tokens and
    ``label_prob`` the probability of the first label. The whole softmax is taken of the first vector alone;
    the others give one number each. Tokens without a vector, or outside it, have no probability.
    """
    vectors = F.col("logits") if "logits" in outputs.columns else F.array("first")
    answers = outputs.select(
        row_id, tail_slice(F.col("sequence"), F.size("labels")).alias("preds"), "labels", vectors.alias("_vectors")
    )
    n = F.least(F.size("preds"), F.size("_vectors"))
    probs = F.zip_with(
        F.slice("_vectors", 1, n), F.slice("preds", 1, n),
        lambda v, p: F.when(p >= 0, F.exp(F.try_element_at(v, p.cast("int") + 1) - log_sum_exp(v))),
    )
    label = F.try_element_at("labels", F.lit(1))
    first = let(
        softmax(F.try_element_at("_vectors", F.lit(1))),
        lambda v: F.struct(topk_tokens(v, k).alias("best"), token_prob(v, label).alias("label_prob")),
    )
    return answers.select(row_id, "preds", "labels", probs.alias("probs"), first.alias("_first")).select(
        row_id, "preds", "labels", "probs", "_first.best", "_first.label_prob"
    )


def score_generation(
    outputs: DataFrame,
    eos_id: int,
    row_id: str = "id",
    k: int = 3,
    out: str | None = None,
) -> dict[str, DataFrame]:
    """Accuracies, probabilities and likeliest tokens of a table of generated sequences.

    The input is that of :func:`scored_outputs`. With ``out`` this is a job: the logits are read once, the
    scored rows are written to ``out/rows`` without them, the accuracies come from the written answers alone
    and are saved as JSON in ``out/metrics``. Gives "rows", "metrics" (``metric, value``), "tokens" (the ``k``
    likeliest first tokens per row) and "label" (the probability of the first label). A row without a
    sequence or labels is in "rows", and counts in no accuracy.
    """
    rows = scored_outputs(outputs, row_id, k)
    if out is not None:
        rows.write.mode("overwrite").parquet(f"{out}/rows")
        rows = outputs.sparkSession.read.parquet(f"{out}/rows")
    metrics = eval_metrics(rows.select("preds", "labels"), eos_id)
    if out is not None:
        save_metrics(metrics, f"{out}/metrics")
        metrics = outputs.sparkSession.read.schema(metrics.schema).json(f"{out}/metrics")
    best = rows.select(row_id, F.posexplode("best").alias("rank", "b"))
    return {
        "rows": rows,
        "metrics": metrics,
        "tokens": best.select(row_id, "rank", F.col("b.token").alias("token"), F.col("b.value").alias("prob")),
        "label": rows.select(row_id, F.col("label_prob").alias("prob")),
    }
