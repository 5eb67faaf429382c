"""Facts that hold for any input: lengths, masks, noise shares, independence of partitions."""

import pytest
from pyspark.sql import functions as F

from checks import views
from seqprep.functions.tokens import vocab_of
from seqprep.operators import collate, metrics, objectives, packing
from seqprep.options import OBJECTIVES_V0, OBJECTIVES_V1, PrepOptions

CASES = [("v1", o) for o in OBJECTIVES_V1] + [("v0", o) for o in OBJECTIVES_V0]


def opts(variant, objective="teacherforcing", **more):
    return PrepOptions(variant=variant, objective=objective, noisy_target=0.5, **more)


@pytest.mark.parametrize("variant, objective", CASES)
def test_lengths_and_masks(star_table, variant, objective):
    made = objectives.examples(star_table, objective, opts(variant), "train")
    prompt = F.array_position("labels", F.element_at(F.filter("labels", lambda x: x != -1), 1)) - 1
    bad = made.filter(
        (F.size("input_ids") != F.size("labels"))
        | (F.size("input_ids") != F.size("attention_mask"))
        | F.exists("attention_mask", lambda x: x != 1)
        | F.exists(F.slice("labels", prompt + 1, F.size("labels") - prompt), lambda x: x == -1)
        | F.exists("input_ids", lambda x: x.isNull())
    )
    assert made.count() == star_table.count()
    assert bad.count() == 0
    ends = made.filter(F.element_at("labels", -1) == vocab_of("numeral-v1").eos_id).count()
    assert ends == (made.count() if variant == "v1" else 0)


@pytest.mark.parametrize("objective", OBJECTIVES_V1)
def test_validation_targets_are_filled_up(star_table, objective):
    longest = objectives.max_target_length(star_table)
    made = objectives.examples(star_table, objective, opts("v1"), "validation", longest)
    assert made.filter(F.size("targets") < longest + 1).count() == 0
    assert made.filter(F.element_at("targets", -1) != 70).count() == 0


@pytest.mark.parametrize("variant, objective", CASES)
@pytest.mark.parametrize("split", ["train", "validation"])
def test_same_rows_under_any_partitioning(star_table, variant, objective, split):
    def rows(n):
        parted = star_table.repartition(n)
        made = objectives.examples(parted, objective, opts(variant), split, 12)
        return sorted(map(str, made.collect()))

    assert rows(1) == rows(4) == rows(32)


def test_draws_differ_between_seeds(star_table):
    a, b = (
        objectives.examples(star_table, "improving", opts("v1", seed=s), "train") for s in (1, 2)
    )
    assert a.join(b, "id").filter(~(a.input_ids == b.input_ids)).count() > 0


def test_noise_shares(spark):
    rows = spark.range(20_000).select("id", F.lit("1,2|3,4/5,6=1,2,3,4,5,6").alias("text"))
    plain = objectives.examples(rows, "teacherforcing", opts("v1"), "train")
    guide = objectives.examples(rows, "noisyguide", opts("v1"), "train")
    place = 10  # second target position
    pairs = guide.join(plain.select("id", F.col("input_ids").alias("clean")), "id")
    changed = pairs.agg(
        F.avg((F.col("input_ids")[place] != F.col("clean")[place]).cast("int")).alias("x"),
        F.max((F.col("input_ids")[place - 1] != F.col("clean")[place - 1]).cast("int")).alias("y"),
    ).first()
    assert changed.x == pytest.approx(0.5 * 5 / 6, abs=0.02)  # six nodes, one of them the old one
    assert changed.y == 0
    single = objectives.examples(rows, "noisytarget", opts("v1"), "train")
    places = single.join(plain.select("id", F.col("labels").alias("clean")), "id").select(
        F.size(F.filter(F.zip_with("labels", "clean", lambda a, b: a != b), lambda d: d)).alias("n")
    )
    assert places.agg(F.max("n")).first()[0] == 1
    mixed = objectives.examples(rows, "mixtask", PrepOptions(mixtask_ratio=0.2), "train")
    short = mixed.agg(F.avg((F.size("input_ids") < 16).cast("int"))).first()[0]
    assert short == pytest.approx(0.2, abs=0.02)


def test_error_detection_marks(star_table):
    made = objectives.examples(star_table, "error_detection", opts("v1"), "validation", 12)
    rows = made.join(star_table.select("id", "len_target"), "id").collect()
    assert rows
    for row in rows:
        n = row.len_target
        told, truth = row.targets[: 2 * n], row.targets[2 * n + 1 : 3 * n + 1]
        marks = [(told[2 * i] != truth[i], told[2 * i + 1] == 57) for i in range(n)]
        assert all(wrong == marked for wrong, marked in marks)
        assert sum(marked for _, marked in marks) == int(0.4 * n)


@pytest.mark.parametrize("size", [40, 1000])
@pytest.mark.parametrize("block", [10, 128, 1000])
def test_packing_matches_a_plain_loop(star_table, size, block):
    made = objectives.examples(star_table, "teacherforcing", opts("v1"), "train")
    examples = [(r.id, r.input_ids, r.labels) for r in made.orderBy("id").collect()]
    expected = {}
    for start in range(0, len(examples), size):
        chunks = [[]]
        for example in examples[start : start + size]:
            if sum(len(e[1]) for e in chunks[-1]) + len(example[1]) <= block:
                chunks[-1].append(example)
            else:
                chunks.append([example])
        for i, chunk in enumerate(chunks):
            expected[start // size, i] = (
                [t for e in chunk for t in e[1]], [t for e in chunk for t in e[2]],
            )
    for per_range in (60, 100_000):
        packed = packing.pack(made, "id", block, batch_rows=size, rows_per_range=per_range)
        got = {(r.batch_id, r.chunk): (r.input_ids, r.labels) for r in packed.collect()}
        assert got == expected


def test_assigned_chunks_agree_with_packed_ones(star_table):
    made = objectives.examples(star_table, "teacherforcing", opts("v1"), "train")
    assigned = packing.pack_assign(made, "id", F.size("input_ids"), 128, 100, 70)
    sums = assigned.groupBy("batch_id", "chunk").agg(F.sum("length").alias("n"))
    packed = packing.pack(made, "id", 128, batch_rows=100, rows_per_range=70)
    lengths = packed.select("batch_id", "chunk", F.size("input_ids").cast("bigint").alias("n"))
    assert sums.exceptAll(lengths).count() == 0
    assert lengths.filter("n > 0").exceptAll(sums).count() == 0


def test_batch_pad(star_table):
    made = objectives.generation_examples(star_table, opts("v0"))
    plain = {r.id: r.input_ids for r in made.collect()}
    ids = sorted(plain)
    for per_range in (90, 100_000):
        padded = collate.batch_pad(made, "id", 32, "left", 55, rows_per_range=per_range)
        rows = {r.id: r for r in padded.collect()}
        assert sorted(rows) == ids
        for start in range(0, len(ids), 32):
            batch = ids[start : start + 32]
            width = max(len(plain[i]) for i in batch)
            for i in batch:
                assert rows[i].batch_id == start // 32
                assert rows[i].input_ids == [55] * (width - len(plain[i])) + plain[i]


def test_metrics_agree_with_each_other(spark, sf_dir):
    preds = views.preds(spark, sf_dir)
    both = {r.metric: r.value for r in metrics.eval_metrics(preds, 70).collect()}
    assert both["seq_acc"] == pytest.approx(metrics.seq_acc(preds, 70).first()["value"])
    for row in metrics.token_acc(preds, 70).collect():
        assert both[f"token_acc_{row.pos}"] == pytest.approx(row.token_acc)
    rows = preds.collect()
    right = [all(p == l for p, l in zip(r.preds, r.labels) if l != 70) for r in rows]
    assert both["seq_acc"] == pytest.approx(sum(right) / len(right))
