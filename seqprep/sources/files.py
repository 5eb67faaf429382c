"""Readers and writers for raw tables, prepared tables, metrics and vocabularies."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqprep.functions.tokens import Vocab
from seqprep.operators.ordering import head_parts, with_row_index
from seqprep.options import PrepOptions, file_format, validate_options

SPLITS = ("train", "validation")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder of the session (``spark.checkpoint.dir``).

    A local session without one, as in tests, uses its warehouse; on a cluster the setting is needed.
    The folder goes at the end of the :func:`scratch_scope` it was made in, else when the session's JVM
    ends: lazy results may read it until then. :func:`sweep_scratch` removes what a crash has left.
    """
    folder = f"{scratch_base(spark)}/{uuid.uuid4().hex}"
    path, store = _store(spark, folder)
    store.mkdirs(path)  # only what is there can be marked for deletion
    scopes = getattr(_SCOPES, "open", None)
    if scopes:
        scopes[-1].append(folder)
    else:
        store.deleteOnExit(path)
    return f"{folder}/data"


def scratch_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/_scratch"


def _store(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    path, store = _store(spark, folder)
    store.delete(path, True)


_SCOPES = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables made inside at its end, by this thread and outside inner scopes.

    What rests on them must have been written by then.
    """
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    made: list[str] = []
    _SCOPES.open.append(made)
    try:
        yield
    finally:
        _SCOPES.open.remove(made)
        for folder in made:
            remove(spark, folder)


class Rounds:
    """Scratch tables of an iteration, each made from the one before: only the last two are kept."""

    def __init__(self, spark: SparkSession):
        self._spark, self._held = spark, []

    def staged(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self._spark)
        df.write.parquet(path)
        self._held.append(path)
        if len(self._held) > 2:
            remove(self._spark, self._held.pop(0).rsplit("/", 1)[0])
        return self._spark.read.schema(df.schema).parquet(path)


def sweep_scratch(spark: SparkSession, hours: float = 24) -> int:
    """Remove scratch folders that are older than ``hours``, as a crash leaves them; returns how many.

    For the start of a day's work: a running job that still reads older tables would lose them.
    """
    base, store = _store(spark, scratch_base(spark))
    if not store.exists(base):
        return 0
    limit = (time.time() - hours * 3600) * 1000
    old = [s.getPath() for s in store.listStatus(base) if s.getModificationTime() < limit]
    for path in old:
        store.delete(path, True)
    return len(old)


def staged(df: DataFrame) -> DataFrame:
    """Write a computed frame to a scratch table and read it back.

    It is computed once however many passes follow, those passes scan only the columns they use,
    and a lost executor costs a read instead of the whole lineage.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_text(spark: SparkSession, path: str, keep_linebreaks: bool = True) -> DataFrame:
    """One row per line in ``text``.

    With ``keep_linebreaks`` every line ends with a line feed, also a last line that had none.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.withColumn("text", F.concat("text", F.lit("\n"))) if keep_linebreaks else lines


def read_file(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    keep_linebreaks: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Read csv (with header), json (one object per line) or txt by extension.

    Give a schema for large inputs: without one csv and json are scanned once more to infer it.
    ``multiline`` allows line breaks inside csv fields, at the price of files that cannot be split.
    """
    kind = file_format(path)
    if kind == "txt":
        return load_text(spark, path, keep_linebreaks)
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "json":
        return reader.json(path)
    return reader.option("inferSchema", schema is None).csv(path, header=True, escape='"')


def with_file_index(df: DataFrame, name: str = "id") -> DataFrame:
    """Add each row's place in the files it was read from, in the order of file and line.

    Rows of one block of a file are read by one task, one after the other, so file, block and a
    running number order them. The rows are written to a scratch table first: the number must not
    be drawn twice.
    """
    placed = staged(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )
    keys = ["_file", "_block", "_line"]
    return with_row_index(placed, keys, name).drop(*keys)


def with_validation(
    parts: dict[str, DataFrame], order_by: str | Sequence[str] | None, pct: float
) -> dict[str, DataFrame]:
    """Cut a missing validation part off the head of the training part."""
    if "validation" in parts:
        return parts
    if order_by is None:
        raise ValueError("a split by head needs order_by: the columns that order the rows")
    return head_parts(parts["train"], order_by, pct)


def load(
    spark: SparkSession,
    train: str | None = None,
    validation: str | None = None,
    order_by: str | Sequence[str] | None = None,
    pct: float = 5,
    schema: StructType | str | None = None,
    keep_linebreaks: bool = True,
) -> dict[str, DataFrame]:
    """Load files as ``{"train": ..., "validation": ...}``.

    Where the column ``order_by`` is missing, it is made: the row's place in its files.
    """
    given = {k: p for k, p in (("train", train), ("validation", validation)) if p is not None}
    if not given:
        raise ValueError("need a train or a validation file")
    parts = {k: read_file(spark, p, schema, keep_linebreaks) for k, p in given.items()}
    if isinstance(order_by, str):
        parts = {k: p if order_by in p.columns else with_file_index(p, order_by) for k, p in parts.items()}
    return with_validation(parts, order_by, pct)


def task_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def save_dir(parts: Mapping[str, DataFrame], path: str) -> None:
    """Write each split as parquet under its own folder."""
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Load a dataset saved by :func:`save_dir`; a plain parquet folder is all training data."""
    parts = {}
    for name in SPLITS:
        try:
            parts[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return parts or {"train": spark.read.parquet(path)}


def load_named(
    spark: SparkSession,
    name: str,
    config: str | None = None,
    order_by: str | Sequence[str] | None = None,
    pct: float = 5,
) -> dict[str, DataFrame]:
    """Load a catalogue table, ``name`` or ``name_config``, split by its ``split`` column.

    A table without that column, or without validation rows, is split by its head.
    """
    table = spark.table(f"{name}_{config}" if config else name)
    if "split" not in table.columns:
        return with_validation({"train": table}, order_by, pct)
    parts = {s: table.filter(F.col("split") == s).drop("split") for s in SPLITS}
    if parts["validation"].isEmpty():
        return with_validation({"train": parts["train"]}, order_by, pct)
    return parts


def load_raw(
    spark: SparkSession, opts: PrepOptions, order_by: str | Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Load whatever source the options name."""
    validate_options(opts)
    if opts.dataset_name is None:
        return load(
            spark, opts.train_file, opts.validation_file, order_by, opts.validation_pct,
            keep_linebreaks=opts.keep_linebreaks,
        )
    if opts.load_from_disk:
        return load_dir(spark, opts.dataset_name)
    return load_named(
        spark, opts.dataset_name, opts.dataset_config, order_by, opts.validation_pct
    )


def text_column(df: DataFrame) -> str:
    """``text`` when there is such a column, else the first one."""
    return "text" if "text" in df.columns else df.columns[0]


def prepared(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Reuse the table at ``path``, or write ``df`` there and read it back.

    The path should carry ``PrepOptions.fingerprint()`` and the input's name. A table counts as
    there once its ``_SUCCESS`` marker is, so a job that failed half-way is written again.
    """
    spark = df.sparkSession
    if not overwrite and finished(spark, path):
        return spark.read.parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _store(spark, path)
    return store.exists(place)


def content_of(spark: SparkSession, opts: PrepOptions) -> str | None:
    """A digest of the files that the options name: paths, sizes and times. ``None`` without files.

    Only the listing is read; for a catalogue table, the files that its rows come from.
    """
    if opts.dataset_name is None or opts.load_from_disk:
        paths = [p for p in (opts.train_file, opts.validation_file) if p]
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        listed = reader.load([opts.dataset_name] if opts.dataset_name else paths)
        files = listed.select("path", "length", "modificationTime")
    else:
        config = opts.dataset_config
        table = spark.table(f"{opts.dataset_name}_{config}" if config else opts.dataset_name)
        try:
            files = table.select(
                "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
            ).distinct()
        except AnalysisException:
            return None
    found = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return f"{found[0]} {found[1]}"


def save_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_vocab(spark: SparkSession, vocab: Vocab, path: str) -> None:
    """Token and id as JSON lines, sorted by token, in one file (the table is tiny)."""
    vocab.frame(spark).orderBy("token").coalesce(1).write.mode("overwrite").json(path)
