"""Streaming sources, example streams and packing of micro-batches.

The example builders are projections, so ``train_examples`` runs on a stream as it is; no state
is kept between micro-batches. Both sinks here write one folder per micro-batch and overwrite it
on a retry, which makes a restart after a lost executor or driver repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seqprep.operators.lego import lego_examples
from seqprep.operators.objectives import train_examples
from seqprep.operators.ordering import head_filter
from seqprep.operators.packing import BATCH_ROWS, pack
from seqprep.operators.shortest import shortest_examples
from seqprep.options import PrepOptions, file_format
from seqprep.sources.files import finished, load_dir, read_file, scratch_scope, staged

FORMATS = ("parquet", "json", "csv", "text")


def load_stream(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: StructType | str,
    max_files: int | None = None,
) -> DataFrame:
    """Read a folder of files lazily; ``max_files`` bounds a micro-batch."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown stream format: {fmt}")
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def stream_table(spark: SparkSession, name: str, config: str | None = None) -> DataFrame:
    """Read a catalogue table, ``name`` or ``name_config``, as a stream."""
    return spark.readStream.table(f"{name}_{config}" if config else name)


def stream_examples(
    df: DataFrame, objective: str, opts: PrepOptions, kind: str = "star"
) -> DataFrame:
    """Training-form examples of every row, on any split: of star, lego or shortest-path rows.

    A lego stream takes its task, a shortest-path stream its augmentation from the options.
    """
    if kind == "lego":
        return lego_examples(df, opts.task, objective, opts, "train")
    if kind == "shortest":
        return shortest_examples(df, objective, opts, "train", opts.aug)
    if kind != "star":
        raise ValueError(f"unknown kind of rows: {kind}")
    return train_examples(df, objective, opts)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder until the present input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_epochs(
    df: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, str], None]
) -> StreamingQuery:
    """Hand each micro-batch to ``write`` with its folder, ``path/epoch=<n>``.

    Scratch tables that it makes go when the micro-batch is written.
    """

    def epoch(batch: DataFrame, n: int) -> None:
        with scratch_scope(batch.sparkSession):
            write(batch, f"{path}/epoch={n}")

    return (
        df.writeStream.foreachBatch(epoch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pack_stream(
    df: DataFrame,
    order_by: str | Sequence[str],
    block_size: int,
    path: str,
    checkpoint: str,
    columns: Sequence[str] = ("input_ids", "attention_mask", "labels"),
    batch_rows: int = BATCH_ROWS,
) -> StreamingQuery:
    """Pack each micro-batch on its own into ``path/epoch=<n>``."""

    def write(batch: DataFrame, folder: str) -> None:
        # Packing reads its rows several times, so they are written once.
        chunks = pack(staged(batch), order_by, block_size, columns, batch_rows)
        chunks.write.mode("overwrite").parquet(folder)

    return write_epochs(df, path, checkpoint, write)


def _file_stream(spark: SparkSession, path: str, keep_linebreaks: bool) -> DataFrame:
    schema = read_file(spark, path, keep_linebreaks=keep_linebreaks).schema
    kind = file_format(path)
    if kind != "txt":
        reader = spark.readStream.schema(schema)
        return reader.json(path) if kind == "json" else reader.csv(path, header=True, escape='"')
    lines = spark.readStream.text(path).withColumnRenamed("value", "text")
    return lines.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else lines


def stream_raw(spark: SparkSession, opts: PrepOptions) -> dict[str, DataFrame]:
    """The splits that the options name as streams, cut where ``load_raw`` cuts them.

    Rows need their id in the data: a stream has no places. Where the head is cut off, the key at the
    cut is looked up in the files first, by a pass over that column alone.
    """
    parts: dict[str, DataFrame]
    if opts.dataset_name is None:
        given = {"train": opts.train_file, "validation": opts.validation_file}
        parts = {k: _file_stream(spark, p, opts.keep_linebreaks) for k, p in given.items() if p is not None}
        whole = lambda: read_file(spark, opts.train_file, keep_linebreaks=opts.keep_linebreaks)
    elif opts.load_from_disk:
        there = load_dir(spark, opts.dataset_name)
        split = len(there) > 1 or finished(spark, f"{opts.dataset_name}/train")
        parts = {
            k: spark.readStream.schema(p.schema).parquet(f"{opts.dataset_name}/{k}" if split else opts.dataset_name)
            for k, p in there.items()
        }
        whole = None
    else:
        table = stream_table(spark, opts.dataset_name, opts.dataset_config)
        name = f"{opts.dataset_name}_{opts.dataset_config}" if opts.dataset_config else opts.dataset_name
        parts, still = {"train": table}, spark.table(name)
        if "split" in table.columns:
            parts["train"] = table.filter("split = 'train'").drop("split")
            if not still.filter("split = 'validation'").isEmpty():
                parts["validation"] = table.filter("split = 'validation'").drop("split")
            still = still.filter("split = 'train'")
        whole = lambda: still
    for name, part in parts.items():
        if opts.row_id not in part.columns:
            raise ValueError(f"a stream needs the column {opts.row_id!r} in its {name} rows")
    if "validation" not in parts and whole is not None:
        inside = head_filter(whole(), opts.row_id, opts.validation_pct)
        parts = {"train": parts["train"].filter(~inside), "validation": parts["train"].filter(inside)}
    return parts
