"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from checks import views
from checks.queries import QUERIES
from seqprep.functions.tokens import oov_rate, vocab_of
from seqprep.operators import collate, metrics, objectives, ordering, packing
from seqprep.options import OBJECTIVES_V1, PrepOptions
from seqprep.sources.files import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("objective", OBJECTIVES_V1)
@pytest.mark.parametrize("split", ["train", "validation"])
def test_examples_are_narrow(star_table, objective, split):
    text = plan(objectives.examples(star_table, objective, PrepOptions(), split, 12))
    assert "Exchange" not in text and "Python" not in text
    columns = re.search(r"ReadSchema: struct<(.*)", text).group(1)
    assert "len_target" not in columns
    needed = objective == "step_eval" or (objective, split) == ("error_detection", "train")
    assert ("wrong_path" in columns) == needed


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("load_", "stream_"))])
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search(r"Window \[.*\], \[\]", text)


def test_head_split_reaches_the_scan(spark, star_table):
    part = ordering.head_parts(star_table, "id", 10)["train"]
    assert "GreaterThan(id" in plan(part)


def test_only_capped_rows_are_built(star_table):
    made = objectives.examples(star_table, "teacherforcing", PrepOptions(), "train")
    text = plan(ordering.cap(made, 50, "id"))
    assert "LessThanOrEqual(id" in text and "Exchange" not in text


def test_rows_are_shuffled_once_for_packing_and_padding(star_table):
    made = staged(objectives.examples(star_table, "teacherforcing", PrepOptions(), "train"))
    spark = made.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = plan(packing.pack(made, "id", 128, batch_rows=50, rows_per_range=100))
        padded = plan(collate.batch_pad(made, "id", 50, rows_per_range=100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (packed, padded):
        # The only exchange of rows with arrays goes by range; what is numbered and listed is narrow.
        wide = [part for part in text.split("Exchange hashpartitioning")[1:] if "labels" in reads(part)]
        assert len(wide) == 1 and wide[0].startswith("(_range")
        windows = [part for part in text.split("Window [")[1:]]
        assert windows and not any("labels" in reads(part) for part in windows)


def reads(part):
    """The columns read by the scan that the beginning of a plan's part rests on."""
    found = re.search(r"ReadSchema: struct<([^\n]*)>", part)
    return found.group(1) if found else ""


def test_rows_of_a_million_ids_pack(spark):
    df = spark.range(40).selectExpr(
        "id", "array_repeat(cast(id as int), if(id % 4 = 0, 3, 1000000)) as input_ids", "input_ids as labels"
    )
    made = staged(df)
    packed = packing.pack(made, "id", 2048).select("batch_id", "chunk", "n_rows", F.size("input_ids").alias("n"))
    rows = packed.orderBy("batch_id", "chunk").collect()
    assert sum(r["n"] for r in rows) == 30 * 1_000_000 + 10 * 3 and sum(r["n_rows"] for r in rows) == 40
    assert [r["n"] for r in rows[:4]] == [3, 1_000_000, 1_000_000, 1_000_000]
    assert collate.batch_pad(made, "id", 1000).agg(F.sum(F.size("input_ids"))).first()[0] == 40_000_000


def test_only_keys_and_lengths_move_for_assignment(star_table):
    made = staged(objectives.examples(star_table, "teacherforcing", PrepOptions(), "train"))
    text = plan(packing.pack_assign(made, "id", F.size("input_ids"), 128))
    assert "labels" not in text and "attention_mask" not in text


def test_bucketed_logits_are_scored_where_they_are(spark, sf_dir):
    logits = views.logits(spark, sf_dir)
    plain = metrics.masked_nll(logits).first()
    logits.write.bucketBy(4, "seq").sortBy("seq", "pos").mode("overwrite").saveAsTable("logits_b")
    table = spark.table("logits_b")
    for df in (metrics.masked_nll(table), metrics.shifted_predictions(table)):
        assert "Exchange hashpartitioning" not in plan(df)
    again = metrics.masked_nll(table).first()
    assert again["n_tokens"] == plain["n_tokens"]
    assert again["loss"] == pytest.approx(plain["loss"])


def test_predictions_are_reduced_before_they_move(spark, sf_dir):
    text = plan(metrics.train_seq_acc(views.logits(spark, sf_dir)))
    below = text[text.index("Exchange hashpartitioning(seq") :]
    assert "array_position" in below  # the arg max is taken on the map side


def test_oov_rate_adds_up_before_the_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = plan(oov_rate(docs, "text", vocab_of("numeral-v1"), "source"))
    assert text.count("Exchange") == 1 and "partial_sum" in text
    assert "ReadSchema: struct<text:string,source:string>" in text
