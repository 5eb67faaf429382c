"""A third of all rows on one key changes no result and meets in no single task."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import views
from checks.compare import database, difference
from checks.oracle import sql
from checks.queries import QUERIES
from seqprep.operators import metrics
from seqprep.sources.files import staged

HOT = ["ex_teacherforcing", "load_json", "oov_rate", "row_index", "metric_flush", "pack_assign"]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The small tables with one order, user, event type and source holding a third of the rows."""
    source, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changed = {
        "lineitem": "SELECT * REPLACE (CASE WHEN random() < 0.33 THEN 7 ELSE l_orderkey END "
        "AS l_orderkey) FROM src",
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 4 ELSE user_id END AS user_id, "
        "CASE WHEN event_id % 3 = 1 THEN 'purchase' ELSE event_type END AS event_type) FROM src",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END "
        "AS source) FROM src",
        "embeddings": "SELECT * FROM src",
    }
    con.execute("SELECT setseed(0.5)")
    for name, query in changed.items():
        con.execute(f"CREATE OR REPLACE VIEW src AS SELECT * FROM '{source}/{name}.parquet'")
        con.execute(f"COPY ({query}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", HOT)
def test_results_are_right(spark, skewed, name):
    assert difference(QUERIES[name](spark, skewed), database(skewed), sql()[name]) is None


@pytest.mark.parametrize("name", ["plain", "skewed"])
def test_every_line_is_in_some_row(spark, sf_dir, skewed, name):
    source = sf_dir if name == "plain" else skewed
    lines = views.table(spark, source, "lineitem")
    rows = views.star(spark, source)
    assert rows.agg(F.sum("len_target")).first()[0] == lines.count()
    assert rows.agg(F.max("len_target")).first()[0] <= views.SEGMENT
    if name == "skewed":
        hot = lines.filter("l_orderkey = 7").count()
        assert hot > lines.count() / 4
        parts = rows.filter(F.col("id") % views.SEGMENT_ID == 7)
        assert parts.agg(F.sum("len_target")).first()[0] == hot
        assert parts.count() == -(-hot // views.SEGMENT)


def test_every_entry_of_a_vector_is_used(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    assert views.logits(spark, sf_dir).filter(F.size("v") != 64).count() == 0
    assert views.lego(spark, sf_dir).count() * views.CHAIN == vectors.count() * 64


def test_hot_split_of_a_log_is_summed_in_parts(spark):
    from seqprep.operators.metrics import metric_flush

    log = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 50 == 0, "eval").otherwise("train").alias("split"),
        F.lit("loss").alias("key"),
        F.col("id").cast("double").alias("value"),
        (F.col("id") % 7 == 0).alias("is_flush"),
    )
    small = {tuple(r) for r in metric_flush(log, rows_per_range=100).collect()}
    assert small == {tuple(r) for r in metric_flush(log).collect()}


@pytest.fixture(scope="module")
def one_long_sequence(spark):
    """Logits of 3,000 positions, a third of them in one sequence; nine in ten labels are masked."""
    seq = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 83 + 1)
    pos = F.floor(F.col("id") / 3).cast("int")
    df = spark.range(3000).select(
        seq.cast("bigint").alias("seq"), pos.alias("pos"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(97)) / 40.0).alias("v"),
        F.when(F.xxhash64("id") % 10 == 0, (F.col("id") % 8).cast("int")).otherwise(-1).alias("label"),
    )
    df = df.dropDuplicates(["seq", "pos"])
    return staged(df)


def test_long_sequences_score_the_same_by_ranges(one_long_sequence):
    df = one_long_sequence
    for measure in (metrics.shift_pairs, metrics.shifted_predictions, metrics.kth_token_acc, metrics.train_seq_acc):
        whole, cut = measure(df), measure(df, longest=100)
        key = lambda r: str(r)
        assert sorted(whole.collect(), key=key) == sorted(cut.select(*whole.columns).collect(), key=key)
    text = metrics.shift_pairs(df, longest=100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in text and "hashpartitioning(seq" not in text


def test_masked_vectors_are_not_shuffled(spark, one_long_sequence):
    df = one_long_sequence
    plain = metrics.masked_nll(df).first()
    for made in (
        metrics.masked_nll(df, filter_from=1), metrics.masked_nll(df, longest=100), metrics.masked_nll(df, in_place=True),
    ):
        found = made.first()
        assert found["n_tokens"] == plain["n_tokens"] and found["loss"] == pytest.approx(plain["loss"])
    shifted = metrics.shift_pairs(df.select("seq", "pos", "label")).filter("label <> -1")
    n = shifted.count()
    passed = df.filter(metrics._among(shifted, n, ["seq", "pos"])).select("seq", "pos")
    assert shifted.select("seq", "pos").exceptAll(passed).count() == 0
    assert n <= passed.count() <= n + 0.12 * df.count() and n < 0.2 * df.count()
