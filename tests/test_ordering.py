"""Row order, splits and caps against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqprep.operators import ordering as o


@pytest.fixture(scope="module")
def table(spark):
    """1,000 rows; a third of them share one source."""
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50))
    return (
        spark.range(1000)
        .select(F.xxhash64("id").alias("key"), source.alias("source"), "id")
        .repartition(7)
    )


@pytest.mark.parametrize("per_range", [1, 10, 333, 100_000])
@pytest.mark.parametrize("order_by", ["key", ["source", "key"]])
def test_row_index(table, per_range, order_by):
    columns = [order_by] if isinstance(order_by, str) else order_by
    indexed = o.with_row_index(table, order_by, rows_per_range=per_range).collect()
    ordered = sorted(indexed, key=lambda r: tuple(r[c] for c in columns))
    assert [r.row_idx for r in ordered] == list(range(1000))


@pytest.mark.parametrize("per_range", [50, 100_000])
def test_nulls_come_first(spark, per_range):
    df = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), "id")
    rows = o.with_row_index(df, "k", rows_per_range=per_range).collect()
    assert sorted((r.row_idx, r.id) for r in rows) == [(i, i) for i in range(200)]


@pytest.mark.parametrize("kind", ["timestamp", "date", "double", "decimal(20,3)", "string"])
def test_key_types(spark, kind):
    base = F.col("id") if kind != "date" else F.date_add(F.lit("2020-01-01"), F.col("id").cast("int"))
    if kind == "timestamp":
        base = F.timestamp_micros(F.col("id") * 1_234_567)
    df = spark.range(300).select("id", base.cast(kind).alias("k"))
    order = sorted(range(300), key=str) if kind == "string" else list(range(300))
    for frame in (
        o.with_row_index(df, "k", rows_per_range=30),
        o.with_batches(df, "k", 7, rows_per_range=30),
    ):
        assert [r.id for r in frame.orderBy("row_idx").collect()] == order
    assert o.key_at(df, "k", 123) == tuple(df.filter(F.col("id") == order[123]).select("k").first())
    assert o.head_split(df, "k", 10).filter("split = 'validation'").count() == 30


@pytest.mark.parametrize("batch, per_range", [(10, 100), (7, 60), (1000, 100), (64, 100_000)])
def test_batches(table, batch, per_range):
    made = o.with_batches(table, ["source", "key"], batch, rows_per_range=per_range)
    rows = sorted(made.collect(), key=lambda r: (r.source, r.key))
    assert [r.row_idx for r in rows] == list(range(1000))
    assert [r.batch_id for r in rows] == [i // batch for i in range(1000)]
    ranges = {}
    for r in rows:
        ranges.setdefault(r.batch_id, set()).add(r._range)
    assert all(len(found) == 1 for found in ranges.values())


@pytest.mark.parametrize("per_range", [100, 100_000])
def test_the_key_must_identify_rows(table, per_range):
    with pytest.raises(Exception, match="must identify a row"):
        o.with_batches(table, "source", 10, rows_per_range=per_range).collect()
    with pytest.raises(Exception, match="must identify a row"):
        o.with_row_index(table, "source", rows_per_range=per_range).collect()


def test_ranges_are_even_although_a_third_of_the_rows_share_a_source(table):
    sizes = (
        o.with_batches(table, ["source", "key"], 10, rows_per_range=100)
        .groupBy("_range")
        .count()
        .collect()
    )
    assert max(r["count"] for r in sizes) <= 120


@pytest.mark.parametrize("position", [0, 1, 499, 999])
def test_key_at(table, position):
    keys = sorted(r.key for r in table.collect())
    for per_range in (40, 100_000):
        ranges = o.key_ranges(table, "key", per_range)
        assert o.key_at(table, "key", position, ranges) == (keys[position],)
    assert o.key_at(table, "key", 1000) is None
    assert o.key_at(table, "key", -1) is None


@pytest.mark.parametrize(
    "rows, pct, size", [(100, 5, 5), (10, 5, 1), (9, 5, 0), (30, 5, 2), (0, 5, 0), (3, 100, 3)]
)
def test_head_size(rows, pct, size):
    assert o.head_size(rows, pct) == size


def test_head_parts(table):
    parts = o.head_parts(table, ["source", "key"], 20)
    ordered = [r.id for r in table.orderBy("source", "key").collect()]
    assert sorted(r.id for r in parts["validation"].collect()) == sorted(ordered[:200])
    assert sorted(r.id for r in parts["train"].collect()) == sorted(ordered[200:])
    empty = o.head_split(table.limit(0), "key")
    assert empty.count() == 0


def test_cap(table):
    first = sorted(r.key for r in table.collect())[:30]
    assert sorted(r.key for r in o.cap(table, 30, "key").collect()) == first
    assert sorted(r.key for r in o.cap(table, 7, "key").collect()) == first[:7]
    assert o.cap(table, 0, "key").count() == 0
    assert o.cap(table, 5000, "key").count() == 1000
    assert o.cap(table, None, "key") is table


@pytest.mark.parametrize("n", [100, 10_500])
def test_cuts_within_a_repeated_key_fail_alike(spark, n):
    df = spark.range(12_000).select(F.when(F.col("id") >= 50, F.col("id") * 0 + 50).otherwise(F.col("id")).alias("k"))
    with pytest.raises(ValueError, match="must identify a row"):
        o.cap(df, n, "k")
    with pytest.raises(ValueError, match="must identify a row"):
        o.head_split(df, "k", 100 * n / 12_000)
    with pytest.raises(Exception, match="must identify a row"):
        o.with_row_index(df, "k").collect()
    assert o.cap(df, 50, "k").count() == 50  # the cut itself is clear
    assert o.cap(df, 12_000, "k").count() == 12_000


@settings(max_examples=25, deadline=None)
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.sampled_from(["", "a", "b", None])), min_size=1, max_size=30),
    st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.sampled_from(["", "a", "b", None])), min_size=1, max_size=40),
)
def test_ranges_are_counts_of_bounds(spark, bounds, rows):
    order = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    bounds = sorted(set(bounds), key=order)
    df = spark.createDataFrame(rows, "a int, b string")
    ranges = o.KeyRanges(spark, df.schema, bounds, len(rows))
    found = [((r.a, r.b), r._range) for r in ranges.mark(df).collect()]
    assert all(n == sum(order(b) <= order(k) for b in bounds) for k, n in found)
    assert len(found) == len(rows)


def test_sample_rows(table, spark):
    a = o.sample_rows(table, "id", 3, seed=1)
    assert a.count() == 3
    assert sorted(map(tuple, a.collect())) == sorted(
        map(tuple, o.sample_rows(table.repartition(31), "id", 3, seed=1).collect())
    )
    assert o.sample_rows(spark.range(2), "id").count() == 2


def test_split_counts(table):
    marked = o.head_split(table, "key", 10)
    got = {r.split: (r.n_rows, r.n_kept) for r in o.split_counts(marked, {"train": 50}).collect()}
    assert got == {"train": (900, 50), "validation": (100, 100)}


@pytest.mark.parametrize("per_range", [13, 100, 100_000])
def test_running_total_with_a_hot_group(spark, per_range):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    df = spark.range(900).select("id", group.alias("g"))
    made = o.running_total(df, "id", F.lit(1), ["g"], "n", rows_per_range=per_range).collect()
    assert {r.id: r.n for r in made if r.g == "hot"} == {3 * i: i for i in range(300)}
    assert all(r.n == 0 for r in made if r.g != "hot")


def test_running_total_needs_an_order_within_each_group(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id long, g string")
    made = o.running_total(df, "id", F.lit(1), ["g"], "n").collect()
    assert sorted((r.g, r.id, r.n) for r in made) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    with pytest.raises(Exception, match="must identify a row"):
        o.running_total(df, "id", F.lit(1), [], "n").collect()
