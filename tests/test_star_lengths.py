"""Validation queries take the longest target from the sizes of the orders, not from the whole view."""

import pytest

from checks import views
from checks.queries import QUERIES
from seqprep.operators import objectives

SIZES = {1: 1, 2: 12, 3: 13, 4: 30, 5: 48, -6: 25, None: 30}


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(o, i, i, 100 + i) for o, n in SIZES.items() for i in reversed(range(n))]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def ends(df):
    return sorted(map(tuple, df.select("id", "len_target").collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_lengths_are_those_of_the_view(spark, orders, monkeypatch, block):
    monkeypatch.setattr(views, "BLOCK", block)
    found = views.star_lengths(spark, orders)
    assert ends(found) == ends(views.star(spark, orders))
    assert objectives.max_target_length(found) == 30


def test_lengths_of_the_tables(spark, sf_dir):
    assert ends(views.star_lengths(spark, sf_dir)) == ends(views.star(spark, sf_dir))


@pytest.mark.parametrize("name", ["ex_reverse_val", "ex_mixtask_v1_val", "ex_malformed"])
def test_the_view_is_not_run_for_its_longest_row(spark, sf_dir, monkeypatch, name):
    asked = []
    real = objectives.max_target_length
    monkeypatch.setattr(objectives, "max_target_length", lambda *parts: asked.extend(parts) or real(*parts))
    QUERIES[name](spark, sf_dir)
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in asked]
    assert plans and not any("Window" in p or "Join" in p for p in plans)
