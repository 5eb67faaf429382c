"""Lines of an order are sorted once and gathered by a window; lines without a key stay one row."""

from checks import views
from checks.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_gathered_by_a_window(spark, sf_dir):
    text = plan(QUERIES["pad_right"](spark, sf_dir))
    assert "Window [collect_list(line" in text
    assert text.count("partial_collect_list(") == 1  # of lines without a key


def test_orders_of_any_length_and_without_a_key(spark, tmp_path):
    sizes = {1: 1, 2: 12, 3: 13, 4: 30, None: 30}
    rows = [(o, i, i, 100 + i) for o, n in sizes.items() for i in reversed(range(n))]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["id"]: r for r in views.star(spark, str(tmp_path)).collect()}
    at = lambda o, segment: o + segment * views.SEGMENT_ID
    lengths = {1: 1, 2: 12, 3: 12, at(3, 1): 1, 4: 12, at(4, 1): 12, at(4, 2): 6, None: 30}
    assert {i: r["len_target"] for i, r in found.items()} == lengths
    told = lambda nodes: ",".join(map(str, nodes))
    assert found[None]["text"].endswith("/0,29=" + told(range(30)))
    assert found[at(4, 2)]["text"].endswith("/24,29=" + told(range(24, 30)))
    assert found[at(4, 2)]["wrong_path"] == [told(range(24, 30)), told([24, *range(29, 24, -1)])]
