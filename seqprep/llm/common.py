"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqprep.sources.files import Rounds, scratch_dir, staged

__all__ = [
    "Rounds", "arrow_rows", "cached", "lower_ascii", "needed", "numbered", "only_cache", "pieces_of", "reachable", "sliced", "scratch_dir", "small",
    "staged", "table", "unused", "UPPER", "LOWER",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def reachable(spark: SparkSession) -> None:
    """Let Python workers that run on this machine import this package, and bound what they are sent.

    A cluster gets the package by its own means (``--py-files``, an image). Texts go to the workers in
    batches, held on both sides; Spark's bound of 64 MB is lowered unless the session has set one.
    """
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


_LIBC = ctypes.CDLL(None)
_CACHES: dict[str, Callable[[], None]] = {}


def cached(name: str, drop: Callable[[], None]) -> None:
    """Tell of a cache that an operator keeps in its Python worker, and how to drop it."""
    _CACHES[name] = drop


def only_cache(name: str) -> None:
    """Drop the caches of other operators, and give freed memory back to the machine: a worker runs
    one operator after the other, and should hold the memory of one."""
    for other, drop in _CACHES.items():
        if other != name:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than that many.

    Asked before a broadcast. The other way is an ordinary join.
    """
    return df.limit(most_rows + 1).count() <= most_rows


BROADCAST_PARTS = 100_000


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``place``, the row's place (from 0) in its group, and ``group_rows``, the group's size.

    The rows are sorted by ranges of ``by`` and ``order`` and written; a place is then that in the
    range plus the rows of the group in ranges before, so groups of any size meet in no single task.
    Equal rows stand in any order, and may lie in several ranges.
    """
    order = [*by, *order, "_row"]
    cut = staged(
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_row")
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = cut.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(
        runs.select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_part").alias("_of"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(group).alias("group_rows"),
        )
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    runs = F.broadcast(runs) if small(runs, BROADCAST_PARTS) else runs
    return cut.join(runs, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("place"), "group_rows")


def pieces_of(rows: int, each: int) -> int:
    """How many pieces of about ``each`` rows; at least one."""
    return max(1, -(-rows // each))


def sliced(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only a few of its texts are Python strings at a time."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def arrow_rows(
    schema: pa.Schema, rows: Iterator[tuple], most: int = 4096, most_bytes: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if hasattr(v, "__len__"))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
