"""Costly columns are computed once a row, whatever filters later steps put on them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.queries import QUERIES
from seqprep.functions.basics import computed_once


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ex_fit_prefix", "ex_teacherforcing_v0", "pad_left", "pad_right", "pad_multiple"])
def test_the_view_is_not_computed_again_by_filters(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("md5(") == 1 and text.count("regexp_extract_all(") == 2


@pytest.mark.parametrize("name", ["ex_step_eval", "ex_error_detection", "ex_error_detection_val", "ex_improving_val"])
def test_lines_are_encoded_once(spark, sf_dir, name):
    wrong = name in ("ex_step_eval", "ex_error_detection")
    assert plan(QUERIES[name](spark, sf_dir)).count("regexp_extract_all(") == 2 + wrong


def test_computed_once_keeps_rows_and_names(spark):
    df = spark.createDataFrame([(1, "a", 2), (None, None, 3), (1, "a", 2)], "id int, `a.b` string, n int")
    made = computed_once(df, n=F.md5("`a.b`"), m=F.length("`a.b`"))
    assert made.columns == ["id", "a.b", "n", "m"]
    digest = hashlib.md5(b"a").hexdigest()
    assert sorted(map(tuple, made.collect()), key=str) == [(1, "a", digest, 1)] * 2 + [(None, None, None, None)]
    assert made.filter("n is null and m is null").count() == 1
    assert plan(made.filter("n is not null")).count("md5(") == 1


def told(owner, path, wrong):
    """Edges of a line as the recipe has them: of a pair with a null only the other one is left."""
    pairs = [",".join(x for x in p if x is not None) for w in (path, wrong) for p in zip(w, w[1:])]
    key = lambda e: hashlib.md5((owner + e).encode()).hexdigest()
    return "|".join(sorted(dict.fromkeys(pairs), key=key))


def test_edges_of_hostile_lines(spark, tmp_path):
    orders = {
        1: [(1, 7)],
        2: [(-3, 4), (-3, 4), (149, 50)],
        3: [(5, 1), (None, 2), (8, None), (9, 3)],
        4: [(6, 6), (None, None), (None, None), (6, 6)],
        None: [(11, 12), (13, 14), (11, 12)],
    }
    rows = [(o, i, p, q) for o, lines in orders.items() for i, (p, q) in enumerate(lines)]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["id"]: r["text"] for r in views.star(spark, str(tmp_path)).collect()}
    assert set(found) == set(orders)
    node = lambda k: None if k is None else str(k % 50 if k >= 0 else -(-k % 50))
    for o, lines in orders.items():
        path = [node(p) for p, _ in lines]
        wrong = [path[0], *[node(q) for _, q in lines[1:]]]
        whole = ",".join(p for p in path if p is not None)
        owner = "" if o is None else f"{o}|"
        assert found[o] == f"{told(owner, path, wrong)}/{path[0]},{path[-1]}={whole}"
