"""The driver contract."""

import __spark_entry__ as contract
from checks.oracle import sql
from checks.queries import QUERIES


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["id", "input_ids", "attention_mask", "labels"]
    assert rows.count() > 0


def test_queries_and_sql_have_the_same_names():
    assert set(QUERIES) == set(sql())
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_sql_is_read_only():
    for text in contract.oracle_sql().values():
        assert text.lstrip().upper().startswith(("WITH", "SELECT"))
