"""Regular lines are encoded, and pairs of neighbours told, as a whole; all others element by element."""

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from seqprep.functions.tokens import encode, encode_tokens, tokenize, vocab_of

LINES = [
    "1,2|3,4/1,4=1,2,4", "0,49|10,9/0,9=", "7", "7=", "=7", "", None, "=", "1,,2", ",1", "1,", "1=,2", "1|=2", "1==", "1,=",
    "50,51,52", "1,50|2", "05,1", "00", "1,100=2", "99", "10", "1 2", " 1,2", "1,2 ", "1,2\n", "1,2=\n", "1,2=\r\n", "1:2", "1,:,2",
    "1,x,2", "1$2", "1;2", "-1,2", "+1,2", "1.5,2", "1e1,2", "١,٢", "1,2,é", "9" * 30, ",".join(["12"] * 20_000) + "=",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind, numbers", [("numeral-v1", n) for n in (5, 10, 20, 37, 50, 100, 110)] + [("numeral-v0", 50), ("lego", 50)])
def test_ids_are_those_of_each_token(spark, kind, numbers):
    vocab = vocab_of(kind, numbers)
    df = spark.createDataFrame(list(enumerate(LINES)), "id int, text string")
    each = encode_tokens(tokenize(F.col("text")), vocab)
    found = df.select("text", encode(F.col("text"), vocab).alias("ids"), each.alias("each")).collect()
    assert len(found) == len(LINES)
    for row in found:
        assert row["ids"] == row["each"], row["text"]
    assert [r["ids"] for r in found if r["text"] == "7"] == [[7 if numbers > 7 else None]] or kind == "lego"


@pytest.mark.parametrize("numbers, whole", [(10, True), (50, True), (100, True), (37, False), (110, False)])
def test_regular_lines_are_cast_as_a_whole(spark, numbers, whole):
    df = spark.createDataFrame([("1,2=3",)], "text string")
    assert ("RLIKE" in plan(df.select(encode(F.col("text"), vocab_of("numeral-v1", numbers))))) is whole


def test_pairs_of_neighbours_are_not_cut_by_patterns(spark, sf_dir):
    assert "regexp_replace(" not in plan(QUERIES["ex_noisyguide"](spark, sf_dir))
