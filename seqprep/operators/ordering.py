"""Row order without a single-task stage.

A Spark table has no order, so every order-dependent operator takes ``order_by``: columns that
together identify a row. Rows are cut into key ranges of even size (bounds from a small
sample), each range is numbered by one task, and the rows in the ranges before it are added.
Any bounds give the same numbering, so the result depends neither on the sample nor on the
number of partitions.

One rule for keys that come twice: an operator fails where its result would depend on the order of
such rows. Numbering needs all keys to be different; a cut by position (head split, row cap) needs
the last row inside and the first one outside to have different keys.

Counting rows, sampling bounds and looking up a key are jobs that run when an operator is called;
what it returns is lazy. The passes before the last read key columns only. Give these operators a table (or a computed
frame written with ``sources.files.staged``): then those passes are column scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from seqprep.functions.basics import let

ROWS_PER_RANGE = 100_000
MAX_RANGES = 32_768  # bounds everything the driver holds: sample, key bounds, counts
SAMPLE_PER_RANGE = 10


def _columns(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in columns]


def at_or_below(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds``, ``most`` at most, are not beyond ``key``: a binary search."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])

    def step(at: Column, power: Column) -> Column:
        fits = (at + power <= F.size(bounds)) & (F.get(bounds, at + power - 1) <= key)
        return F.when(fits, at + power).otherwise(at)

    return F.aggregate(powers, F.lit(0), step)


@dataclass(frozen=True)
class KeyRanges:
    """Ranges of the order key: ``len(bounds) + 1`` of them, each bound opening one."""

    spark: SparkSession
    key_type: StructType
    bounds: list[tuple]
    rows: int

    @property
    def columns(self) -> list[str]:
        return self.key_type.names

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.columns])

    def literal(self, values: tuple) -> Column:
        fields = zip(self.key_type.fields, values)
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in fields])

    def mark(self, df: DataFrame) -> DataFrame:
        """Add ``_range``: the number of bounds at or below the row's key, by binary search.

        The bounds enter the plan as one scalar subquery, that is as a constant array. Powers of
        two, the largest first, are added up as long as the bound at that place is not beyond.
        """
        n = len(self.bounds)
        if not n:
            return df.withColumn("_range", F.lit(0))
        schema = StructType([StructField("bounds", ArrayType(self.key_type))])
        table = self.spark.createDataFrame([(self.bounds,)], schema)
        marked = df.withColumn("_bounds", table.scalar())
        found = let(F.col("_bounds"), lambda bounds: at_or_below(bounds, self.key(), n))
        return marked.withColumn("_range", found).drop("_bounds")


def key_ranges(
    df: DataFrame, order_by: str | Sequence[str], rows_per_range: int = ROWS_PER_RANGE
) -> KeyRanges:
    """Count the rows and, when they do not fit one range, sample bounds for even ranges."""
    keys = df.select(*_columns(order_by))
    rows = keys.count()
    wanted = min(-(-rows // rows_per_range), MAX_RANGES)
    if wanted <= 1:
        return KeyRanges(df.sparkSession, keys.schema, [], rows)
    # About MAX_RANGES * SAMPLE_PER_RANGE keys reach the driver at most.
    fraction = min(1.0, wanted * SAMPLE_PER_RANGE / rows)
    sample = keys.sample(fraction=fraction, seed=7).orderBy(*_order(keys.columns))
    found = [tuple(r) for r in sample.collect()]
    picked = [found[i * len(found) // wanted] for i in range(1, wanted)] if found else []
    return KeyRanges(df.sparkSession, keys.schema, list(dict.fromkeys(picked)), rows)


def _offsets(df: DataFrame, ranges: KeyRanges) -> list[int]:
    """Rows before each range: one count per range, at most MAX_RANGES of them."""
    counted = ranges.mark(df.select(*ranges.columns)).groupBy("_range").count().collect()
    sizes = {row["_range"]: row["count"] for row in counted}
    return [0, *accumulate(sizes.get(r, 0) for r in range(ranges.count))]


def _once(ranges: KeyRanges, in_order: WindowSpec, value: Column) -> Column:
    """``value``, or a failure when a key comes twice in its window: the order of such rows, and
    with it the result, would change from run to run."""
    again = F.lag(ranges.key()).over(in_order).eqNullSafe(ranges.key())
    message = F.lit(f"order_by must identify a row, but {ranges.columns} has the same values twice")
    return F.when(again, F.raise_error(message).cast("bigint")).otherwise(value)


def _place(ranges: KeyRanges) -> Column:
    """Zero-based place of a row in its range."""
    in_order = Window.partitionBy("_range").orderBy(*_order(ranges.columns))
    return _once(ranges, in_order, (F.row_number().over(in_order) - 1).cast("bigint"))


def _numbered(df: DataFrame, ranges: KeyRanges, name: str) -> DataFrame:
    """Add ``_range`` and the zero-based position in the whole order."""
    position = _place(ranges)
    if ranges.bounds:
        table = ranges.spark.createDataFrame([(_offsets(df, ranges),)], "o array<bigint>")
        position = position + F.element_at(table.scalar(), F.col("_range") + 1)
    return ranges.mark(df).withColumn(name, position)


def with_row_index(
    df: DataFrame,
    order_by: str | Sequence[str],
    name: str = "row_idx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the zero-based position of each row in the given order."""
    return _numbered(df, key_ranges(df, order_by, rows_per_range), name).drop("_range")


def with_batches(
    df: DataFrame,
    order_by: str | Sequence[str],
    batch_rows: int,
    name: str = "row_idx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``_range``, the row position and ``batch_id`` for batches of consecutive rows.

    The rows move once, by range: grouping them by ``_range, batch_id`` afterwards needs no further
    shuffle. A window numbers them, which holds the rows of a range: give it narrow ones, and lead
    what is found back to wide rows by :func:`in_runs`.
    """
    return batched(df, order_by, batch_rows, name, rows_per_range)[0]


def batched(
    df: DataFrame,
    order_by: str | Sequence[str],
    batch_rows: int,
    name: str = "row_idx",
    rows_per_range: int = ROWS_PER_RANGE,
) -> tuple[DataFrame, KeyRanges]:
    """:func:`with_batches`, and its ranges, each of a whole number of batches.

    The key columns alone are numbered first, to find the keys at which such ranges begin.
    """
    columns = _columns(order_by)
    ranges = key_ranges(df, columns, rows_per_range)
    batch = F.floor(F.col(name) / batch_rows).cast("bigint")
    if not ranges.bounds:
        return _numbered(df, ranges, name).withColumn("batch_id", batch), ranges
    step = -(-ranges.rows // (ranges.count * batch_rows)) * batch_rows
    opening = F.when((F.col("_idx") % step == 0) & (F.col("_idx") > 0), ranges.key())
    found = (
        _numbered(df.select(*columns), ranges, "_idx")
        .agg(F.sort_array(F.collect_list(opening)).alias("bounds"))
        .first()["bounds"]
    )
    exact = KeyRanges(ranges.spark, ranges.key_type, [tuple(b) for b in found], ranges.rows)
    position = F.col("_range").cast("bigint") * step + _place(exact)
    return exact.mark(df).withColumn(name, position).withColumn("batch_id", batch), exact


def in_runs(df: DataFrame, ranges: KeyRanges, runs: DataFrame) -> DataFrame:
    """Add ``_range`` and the columns of the run that a row lies in.

    ``runs`` has one row for each run of consecutive rows: ``_range``, ``_key`` (that of its first row,
    a struct of the key columns) and any columns; of runs with the same key the last one counts. Those
    of a range become one array, in which a row finds its own by binary search.
    The rows of ``df``, which may be wide, move by ``_range`` at most, or not at all when the runs are
    few; no window holds them.
    """
    told = [c for c in runs.columns if c not in ("_range", "_key")]
    # All ranges but the last have the same number of rows; a batch has one run more than rows at most.
    rows = ranges.rows if ranges.count == 1 else (ranges.rows - 1) // (ranges.count - 1)
    lists = (
        runs.groupBy("_range")
        .agg(F.sort_array(F.collect_list(F.struct("_key", *told))).alias("_runs"))
        .select("_range", F.col("_runs._key").alias("_keys"), F.transform("_runs", lambda r: r.dropFields("_key")).alias("_runs"))
    )
    if ranges.bounds:
        joined = ranges.mark(df).join(lists, "_range")
    else:  # one range: its lists are one value
        joined = ranges.mark(df).withColumn("_told", lists.select(F.struct("_keys", "_runs")).scalar())
        joined = joined.select("*", "_told.*").drop("_told")
    run = F.get("_runs", at_or_below(F.col("_keys"), ranges.key(), 2 * rows + 1) - 1)
    return joined.withColumn("_run", run).select("_range", *df.columns, *[F.col(f"_run.{c}").alias(c) for c in told])


def key_at(
    df: DataFrame,
    order_by: str | Sequence[str],
    position: int,
    ranges: KeyRanges | None = None,
    last: bool = False,
) -> tuple | None:
    """The order key at a zero-based position, or ``None`` past the end.

    Only the range that holds the position is sorted. With ``last`` the key is to end a part, and
    the next row must not have it too.
    """
    ranges = ranges or key_ranges(df, order_by)
    if position < 0 or position >= ranges.rows:
        return None
    keys = df.select(*ranges.columns)
    offset = 0
    if ranges.bounds:
        offsets = _offsets(keys, ranges)
        target = max(r for r in range(ranges.count) if offsets[r] <= position)
        offset = offsets[target]
        keys = ranges.mark(keys).filter(F.col("_range") == target)
    else:
        keys = keys.withColumn("_range", F.lit(0))
    within = Window.partitionBy("_range").orderBy(*_order(ranges.columns))
    following = F.lead(ranges.key()).over(within).eqNullSafe(ranges.key())
    row = (
        keys.withColumn("_n", F.row_number().over(within))
        .withColumn("_again", following)
        .filter(F.col("_n") == position - offset + 1)
        .select("_again", *ranges.columns)
        .first()
    )
    if row is None:
        return None
    if last and row["_again"]:
        raise ValueError(
            f"order_by must identify a row, but {ranges.columns} has the same values on both sides of a cut"
        )
    return tuple(row)[1:]


def _up_to(df: DataFrame, columns: list[str], key: tuple) -> Column:
    """Rows at or before ``key``. With one column this is a filter the scan can use."""
    if len(columns) == 1:
        column, value = F.col(columns[0]), key[0]
        if value is None:
            return column.isNull()
        return column.isNull() | (column <= F.lit(value).cast(df.schema[columns[0]].dataType))
    ranges = KeyRanges(df.sparkSession, df.select(*columns).schema, [], 0)
    return ranges.key() <= ranges.literal(key)


def head_size(rows: int, pct: float) -> int:
    """``rows * pct / 100`` rounded half up."""
    return int((rows * pct * 2 + 100) // 200)


def head_filter(df: DataFrame, order_by: str | Sequence[str], pct: float) -> Column:
    """Whether a row is in the first ``pct`` percent, also of a stream of the same rows.

    The key at the cut is found first; the rows themselves are then only compared with it, so
    nothing but keys is shuffled.
    """
    ranges = key_ranges(df, order_by)
    key = key_at(df, order_by, head_size(ranges.rows, pct) - 1, ranges, last=True)
    return F.lit(False) if key is None else _up_to(df, ranges.columns, key)


def head_split(df: DataFrame, order_by: str | Sequence[str], pct: float = 5) -> DataFrame:
    """Mark the first ``pct`` percent as "validation" and the rest as "train" in ``split``."""
    inside = head_filter(df, order_by, pct)
    return df.withColumn("split", F.when(inside, F.lit("validation")).otherwise(F.lit("train")))


def head_parts(
    df: DataFrame, order_by: str | Sequence[str], pct: float = 5
) -> dict[str, DataFrame]:
    """The two parts of :func:`head_split`, each behind a filter the scan can use."""
    inside = head_filter(df, order_by, pct)
    return {"train": df.filter(~inside), "validation": df.filter(inside)}


def cap(df: DataFrame, n: int | None, order_by: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows; all of them when ``n`` is ``None`` or more than there are.

    The key of the last row is looked up and becomes a filter, so only keys are shuffled, no task
    gathers the rows, and costly columns are computed for rows inside the cap only.
    """
    return df if n is None else df.filter(cap_filter(df, n, order_by))


def cap_filter(df: DataFrame, n: int | None, order_by: str | Sequence[str]) -> Column:
    """Whether a row is among the first ``n``, also of a stream of the same rows."""
    if n is None:
        return F.lit(True)
    columns = _columns(order_by)
    key = key_at(df, columns, n - 1, last=True) if n > 0 else None
    if key is None:
        return F.lit(n > 0)
    return _up_to(df, columns, key)


def sample_rows(df: DataFrame, key: str, n: int = 3, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a hash of their key; all rows when there are fewer."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, F.col(key)).limit(n)


def split_counts(df: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Rows per ``split``, and how many a cap leaves: ``split, n_rows, n_kept``."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = F.col("n_rows")
    for name, limit in (caps or {}).items():
        if limit is not None:
            kept = F.when(F.col("split") == name, F.least(F.lit(limit), F.col("n_rows"))).otherwise(
                kept
            )
    return counts.withColumn("n_kept", kept.cast("bigint"))


def running_total(
    df: DataFrame,
    order_by: str | Sequence[str],
    value: Column,
    by: Sequence[str],
    name: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same ``by`` group.

    A group may be any share of the table: it is summed range by range, and the totals of the
    ranges before (one row per group and range) are joined on.
    """
    ranges = key_ranges(df, order_by, rows_per_range)
    marked = ranges.mark(df).withColumn("_value", value.cast("bigint"))
    in_order = Window.partitionBy(*by, "_range").orderBy(*_order(ranges.columns))
    before_row = in_order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_value").over(before_row), F.lit(0))
    inside = _once(ranges, in_order, inside)
    if not ranges.bounds:
        return marked.withColumn(name, inside).drop("_range", "_value")
    before_range = (
        Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        marked.groupBy(*by, "_range")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before_range), F.lit(0)))
        .drop("_total")
    )
    return (
        marked.withColumn(name, inside)
        .join(totals, [*by, "_range"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .select(*df.columns, name)
    )


def following(
    df: DataFrame,
    group: str,
    order: str,
    columns: Sequence[str],
    name: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``name``: the ``columns`` of the next row of the same group, as a struct; null for the last.

    A group may be any share of the table: rows look behind them within a range of keys, and the last
    of a range at the first of the next one (one row for each range).
    """
    ranges = key_ranges(df, [group, order], rows_per_range)
    marked = ranges.mark(df)
    value = F.struct(group, *columns)
    in_order = Window.partitionBy("_range").orderBy(*_order(ranges.columns))
    found = F.lead(value).over(in_order)
    if ranges.bounds:
        firsts = marked.groupBy("_range").agg(F.min_by(value, ranges.key()).alias("_first"))
        edges = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_edge"))
        marked = marked.join(F.broadcast(edges), "_range")  # MAX_RANGES rows at most
        found = F.coalesce(found, F.col("_edge"))
    told = marked.withColumn("_next", found)
    same = F.col(f"_next.{group}").eqNullSafe(F.col(group))
    return told.withColumn(name, F.when(same, F.col("_next").dropFields(group))).select(*df.columns, name)
