"""Rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from seqprep.functions import tokens as tok
from seqprep.functions import vectors as vec
from seqprep.operators import collate, lego, metrics, objectives, packing, preference, shortest
from seqprep.options import PrepOptions

V1 = tok.vocab_of("numeral-v1")
LINE = "12,3|3,7/12,7=12,3,7"
PROMPT = [12, 3, 50, 3, 7, 52, 12, 7, 51]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame(
        [(1, f" {LINE}\n", 3, ["12,7,3"])],
        "id long, text string, len_target int, wrong_path array<string>",
    )


def one(df, *columns):
    row = df.first()
    return tuple(row[c] for c in columns)


def test_vocabularies(spark):
    ids = {r.token: r.id for r in V1.frame(spark).collect()}
    assert len(ids) == V1.size == 70 == V1.eos_id
    assert [ids[s] for s in "|=/$?&*-+><[](){};."] == list(range(50, 69))
    assert ids[":"] == -1 and ids["49"] == 49
    assert tok.vocab_of("numeral-v0").size == 55
    lego_ids = {r.token: r.id for r in tok.vocab_of("lego").frame(spark).collect()}
    assert len(lego_ids) == 37 and lego_ids[":"] == 34 and lego_ids["F"] == 36


def test_vocabulary_choice():
    assert tok.vocab_kind_for("x/lego-6") == "lego"
    assert tok.vocab_kind_for("shortest_50") == "numeral-v1"
    assert tok.vocab_kind_for("anything", preference=True) == "numeral-v0"
    with pytest.raises(ValueError):
        tok.vocab_kind_for("star")
    with pytest.raises(ValueError):
        tok.vocab_of("other")


@pytest.mark.parametrize(
    "text, ids",
    [
        ("12,3|3,7/12,7=", PROMPT),
        ("z", [None]),
        ("07", [None]),
        ("7 50:.", [7, None, None, -1, 68]),
        ("é😀,１", [None, None, None]),
        ("99999999999999999999", [None]),
        ("", []),
    ],
)
def test_encode(spark, text, ids):
    df = spark.createDataFrame([(text,)], "text string")
    assert one(df.select(tok.encode(F.col("text"), V1).alias("ids")), "ids") == (ids,)
    counts = df.select(
        tok.token_count(F.col("text")).alias("n"), tok.unknown_count(F.col("text"), V1).alias("u")
    )
    assert one(counts, "n", "u") == (len(ids), ids.count(None))


def test_many_nodes_need_no_table(spark):
    big = tok.vocab_of("numeral-v1", 200_000)
    df = spark.createDataFrame([("199999,200000|",)], "text string")
    ids = tok.encode(F.col("text"), big)
    assert one(df.select(ids.alias("i")), "i") == ([199999, None, 200000],)
    back = df.select(tok.ids_to_tokens(ids, big).alias("t"))
    assert one(back, "t") == (["199999", None, "|"],)


@pytest.mark.parametrize(
    "tokens, text",
    [
        ("1 2 | 2 3 / 1 3 = 1 2 3".split(), "1,2|2,3/1,3=1,2,3"),
        (["1", None], "1,<|unk|>"),
        ("1 < - : 2".split(), "1,<,-:,2"),
        ([], ""),
    ],
)
def test_detokenize(spark, tokens, text):
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    assert one(df.select(tok.detokenize(F.col("t"), V1).alias("x")), "x") == (text,)


def test_strip_and_parts(spark):
    df = spark.createDataFrame(
        [("  a=b\x0b",), ("a=b=c",), ("ab",), ("=",), (None,)], "text string"
    )
    accepted, rejects = tok.split_prompt_target(df, "text")
    assert {(r.prompt, r.target) for r in accepted.collect()} == {("a=", "b"), ("=", "")}
    assert {r.text for r in rejects.collect()} == {"a=b=c", "ab", None}


def build(df, objective, split="train", **options):
    opts = PrepOptions(**options)
    return objectives.examples(df, objective, opts, split, 5)


def test_teacherforcing(line):
    ids, mask, labels = one(
        build(line, "teacherforcing"), "input_ids", "attention_mask", "labels"
    )
    assert ids == PROMPT + [12, 3, 7, 70]
    assert labels == [-1] * 9 + [12, 3, 7, 70]
    assert mask == [1] * 13


def test_teacherless_and_reverse(line):
    ids, labels = one(build(line, "teacherless"), "input_ids", "labels")
    assert ids == PROMPT + [12, 53, 53, 70] and labels == [-1] * 9 + [12, 3, 7, 70]
    assert one(build(line, "reverse"), "input_ids") == (PROMPT + [7, 3, 12, 70],)
    assert one(build(line, "reverse", "validation"), "targets") == ([7, 3, 12, 70, 70, 70],)


def test_mixtask_v1(line):
    ids, labels = one(build(line, "mixtask", mixtask_ratio=1.0), "input_ids", "labels")
    assert ids == PROMPT[:-1] + [55, 3, 70] and labels == [-1] * 9 + [3, 70]
    full = build(line, "mixtask", "validation", mixtask_ratio=0.0)
    assert one(full, "input_ids", "targets") == (PROMPT, [12, 3, 7, 70, 70, 70])
    short = build(line, "mixtask", "validation", mixtask_ratio=1.0)
    assert one(short, "input_ids", "targets") == (PROMPT[:-1] + [55], [3, 70, 70, 70, 70, 70])


def test_mixtask_v0_short_targets_stay_whole(line):
    made = build(line, "mixtask", variant="v0", mixtask_ratio=0.0)
    assert one(made, "input_ids") == (PROMPT + [12, 3, 7],)


def test_mixtask_v0(spark):
    df = spark.createDataFrame([(1, "1,2=1,2,3,4", 4)], "id long, text string, len_target int")
    ids, labels = one(build(df, "mixtask", variant="v0", mixtask_ratio=0.0), "input_ids", "labels")
    assert ids == [1, 2, 51, 53, 53, 3] and labels == [-1] * 5 + [3]


def test_fit_prefix(line):
    ids, labels = one(build(line, "fit_prefix"), "input_ids", "labels")
    assert ids == labels == PROMPT + [12, 3, 7, 70]


def test_step_eval_validation(line):
    ids, targets = one(build(line, "step_eval", "validation"), "input_ids", "targets")
    assert ids == PROMPT[:-1] + [60, 12, 7]
    assert targets == [3, 57, 12, 3, 7, 59, 12, 3, 7, 70]


def test_step_eval_short_is_another_name_in_training(line):
    short, full = build(line, "step_eval_short"), build(line, "step_eval")
    assert one(short, "input_ids", "labels") == one(full, "input_ids", "labels")


def test_error_detection_rejects(spark):
    df = spark.createDataFrame(
        [(1, "1,2=1,2", ["1"]), (2, "1,2=1,2,1", ["1"]), (3, "1=1,1,1", ["1"]), (4, "bad", ["1"])],
        "id long, text string, wrong_path array<string>",
    )
    opts = PrepOptions()
    made = objectives.examples(df, "error_detection", opts, "validation", 5)
    assert [r.id for r in made.collect()] == [2]
    left = objectives.rejected(df, "error_detection", opts, "validation")
    assert {(r.id, r.reason) for r in left.collect()} == {(1, "target"), (3, "target"), (4, "parts")}


def test_colon_is_an_ignored_label_and_a_node(spark):
    df = spark.createDataFrame([(1, "1,2:=1:2", 2)], "id long, text string, len_target int")
    ids, labels = one(build(df, "teacherforcing"), "input_ids", "labels")
    assert ids == [1, 2, -1, 51, 1, -1, 2, 70] and labels == [-1] * 4 + [1, -1, 2, 70]
    nodes = df.select(tok.node_set(tok.encode(F.col("text"), V1), 50).alias("n"))
    assert one(nodes, "n") == ([-1, 1, 2],)


def test_unknown_objective_and_label_noise(line):
    with pytest.raises(ValueError):
        build(line, "fit_prefix", variant="v0")
    with pytest.raises(ValueError):
        build(line, "noisyguide", alter_label=True)


def test_preference(line, spark):
    pairs = preference.preference_pairs(line)
    assert one(pairs, "prompt", "chosen", "rejected") == ("12,3|3,7/12,7=", "12,3,7", "12,7,3")
    assert preference.preference_max_length(pairs, "id", 3) == 12
    same = spark.createDataFrame([(1, "1=2", "2")], "id long, text string, wrong_path string")
    assert preference.preference_pairs(same).count() == 1
    assert preference.preference_pairs(same, drop_equal=True).count() == 0


def test_shortest(spark):
    df = spark.createDataFrame(
        [(1, "1,2|2,3/1,3", "1,2,3", "1,2,2,3", ["1,2", "2,3"])],
        "id long, query string, target string, steps string, trace array<string>",
    )
    query, text = shortest.shortest_text("pause")
    assert one(df.select(query.alias("q"), text.alias("t")), "q", "t") == (
        "1,2|2,3/1,3<", "1($),2($)-3,2,1>=1,2,3",
    )
    opts = PrepOptions()
    made = shortest.shortest_examples(df, "teacherforcing", opts, "train")
    ids, labels = one(made, "input_ids", "labels")
    query_ids = [70, 1, 2, 50, 2, 3, 52, 1, 3, 51]
    assert ids == query_ids + [1, 2, 3, 70] and labels == [-1] * 10 + [1, 2, 3, 70]
    long = df.withColumn("target", F.concat_ws(",", F.array_repeat(F.lit("1"), 52)))
    targets = one(shortest.shortest_examples(long, "teacherforcing", opts, "validation"), "targets")
    assert targets == ([1] * 50,)
    with pytest.raises(ValueError):
        shortest.shortest_examples(df, "reverse", opts, "train")


def test_lego(spark):
    text = "z=-u|u=+a/a=+1,z=?u=+a=+1:z=-u=-1"
    df = spark.createDataFrame([(1, text, "T")], "id long, symbol_text string, target_direct string")
    opts = PrepOptions()
    targets = one(lego.lego_extract(df, opts, "validation", "symbol_text"), "targets")
    assert targets == ([26, 26, 27],)
    with pytest.raises(ValueError):
        lego.lego_examples(df, "direct", "noisytarget", opts, "train")


@pytest.mark.parametrize(
    "lengths, chunks",
    [
        ([3, 4, 5, 9, 1], [[3, 4], [5], [9], [1]]),
        ([9, 1], [[], [9], [1]]),
        ([8], [[8]]),
        ([0, 8, 0, 1], [[0, 8, 0], [1]]),
    ],
)
def test_packing(spark, lengths, chunks):
    rows = [(i, [i] * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    packed = packing.pack(df, "id", 8, ["ids"]).orderBy("chunk").collect()
    left = iter(range(len(lengths)))
    expected = [[i for n in chunk for i in [next(left)] * n] for chunk in chunks]
    assert [r.ids for r in packed] == expected
    assert [r.n_rows for r in packed] == [len(c) for c in chunks]


def test_padding(spark):
    df = spark.createDataFrame(
        [(1, [1, 2], [5, 6], [0, 0], [0, 1])],
        "id long, input_ids array<int>, labels array<int>, token_type_ids array<int>, "
        "special_tokens_mask array<int>",
    )
    left = collate.pad(df, 5, "left", 70, token_type_pad_id=9)
    assert one(left, "input_ids", "attention_mask", "labels") == (
        [70, 70, 70, 1, 2], [0, 0, 0, 1, 1], [-1, -1, -1, 5, 6],
    )
    assert one(left, "token_type_ids", "special_tokens_mask") == (
        [9, 9, 9, 0, 0], [1, 1, 1, 0, 1],
    )
    assert one(collate.pad(df, 1, "right", 70), "input_ids") == ([1, 2],)
    assert len(one(collate.pad(df, 13, "right", 70, multiple=8), "input_ids")[0]) == 16
    assert len(one(collate.pad(df, strategy="longest", multiple=8), "input_ids")[0]) == 8
    assert one(collate.pad(df, strategy="none"), "attention_mask") == ([1, 1],)
    for wrong in ({"side": "top", "length": 3}, {"strategy": "other"}, {}):
        with pytest.raises(ValueError):
            collate.pad(df, **wrong)


def test_accuracies(spark):
    df = spark.createDataFrame(
        [(1, [1, 3, 5], [1, 2, 70]), (2, [1, 9, 9], [1, 70, 70]), (3, [4, 4, 4], [70, 70, 70])],
        "id long, preds array<int>, labels array<int>",
    )
    two = {r.metric: r.value for r in metrics.eval_metrics(df.filter("id < 3"), 70).collect()}
    assert two["seq_acc"] == 0.5
    assert two["token_acc_0"] == pytest.approx(1.0, abs=1e-6)
    assert two["token_acc_1"] == two["token_acc_2"] == 0.0
    assert metrics.seq_acc(df, 70).first()["value"] == pytest.approx(2 / 3)


def test_flush(spark):
    rows = [
        (1, "train", "a", 1.0, False), (2, "train", "a", 3.0, False), (3, "train", "", 0.0, True),
        (4, "train", "a", 5.0, False), (5, "train", "", 0.0, True), (6, "train", "a", 8.0, False),
        (7, "eval", "a", 9.0, False),
    ]
    df = spark.createDataFrame(rows, "seq long, split string, key string, value double, is_flush boolean")
    for size in (2, 100):
        got = metrics.metric_flush(df, rows_per_range=size).collect()
        assert sorted((r.split, r.flush_id, r.value) for r in got) == [
            ("train", 0, 2.0), ("train", 1, 5.0),
        ]
    assert metrics.metric_flush(df, keep_open=True).count() == 4


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.5], 2)], "v array<double>, label int")
    v = F.col("v")
    row = df.select(
        vec.argmax(v).alias("best"),
        vec.softmax(v).alias("p"),
        vec.token_prob(vec.softmax(v), F.col("label")).alias("lp"),
        vec.topk_tokens(v, 3).alias("top"),
        vec.token_nll(v, F.col("label")).alias("nll"),
        vec.tail_slice(v, F.lit(2)).alias("tail"),
        vec.tail_slice(v, F.lit(9)).alias("whole"),
    ).first()
    assert row.best == 1 and sum(row.p) == pytest.approx(1.0)
    assert [t.token for t in row.top] == [1, 2, 0]
    assert row.lp == pytest.approx(2.718281828 ** -row.nll)
    assert row.tail == [3.0, 0.5] and row.whole == [1.0, 3.0, 3.0, 0.5]


def test_shift_and_kth(spark):
    rows = [(1, 0, [0.0, 1.0], -1), (1, 1, [1.0, 0.0], 1), (1, 2, [0.0, 1.0], 0), (2, 0, [9.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "seq long, pos int, v array<double>, label int")
    shifted = metrics.shifted_predictions(df).orderBy("pos").collect()
    assert [(r.seq, r.pos, r.pred, r.label, r.correct) for r in shifted] == [
        (1, 0, 1, 1, 1), (1, 1, 0, 0, 1),
    ]
    assert {(r.k, r.kth_acc) for r in metrics.kth_token_acc(df).collect()} == {(1, 1.0), (2, 1.0)}
    assert metrics.train_seq_acc(df).first()["value"] == 1.0


def test_perplexity_overflows_to_infinity(spark):
    df = spark.createDataFrame(
        [(1, 0, [0.0, 5000.0], -1), (1, 1, [0.0, 0.0], 0)],
        "seq long, pos int, v array<double>, label int",
    )
    assert metrics.perplexity(df).first()["perplexity"] == float("inf")


def test_fixture_sizes(spark):
    """Row counts stated in FIXTURES.md."""
    from checks import views

    sf = "/root/testdata/sf0.01"
    first = views.star(spark, sf).filter("id = 2").first()
    assert first.text == "46,25|30,28|46,14|25,30|14,38|38,6|6,2|28,5/46,2=46,14,38,6,2"
    assert first.wrong_path == ["46,25,30,28,5", "46,5,28,30,25"]
    assert views.star(spark, sf).count() == 14749
    assert metrics.metric_flush(views.metric_log(spark, sf), keep_open=True).count() == 3971


def test_bad_rows_are_listed_and_never_null(spark):
    from seqprep.operators.lego import lego_examples, lego_rejected

    opts = PrepOptions()
    rows = [
        (1, "1,2/1,2=1,2", ["1,2", "1,3"]), (2, "1,2/1,2=1,2", None), (3, "1,2/1,2=1,2", []),
        (4, "1,2/1,2=1,2", [None, "1,3"]), (5, "1,2/1,2=", ["1,2"]), (6, "no parts", ["1"]), (7, None, ["1"]),
    ]
    df = spark.createDataFrame(rows, "id bigint, text string, wrong_path array<string>")
    for split in ("train", "validation"):
        for objective in ("step_eval", "mixtask", "error_detection", "teacherforcing"):
            made = objectives.examples(df, objective, opts, split, 4).collect()
            out = objectives.rejected(df, objective, opts, split).collect()
            assert sorted([r.id for r in made] + [r.id for r in out]) == [1, 2, 3, 4, 5, 6, 7]
            assert all(v is not None for r in made for v in r)
    chains = [
        (1, "a=+b/b=+1,a=?x", "s", "d", "p", "s?T"), (2, "a?b", None, None, None, None),
        (3, "a", "s", "d", "p", "s?T"), (4, "a?b", "s", "d", "p", "no verdict"),
    ]
    names = "id bigint, symbol_text string, target_steps string, target_direct string, target_path string, target_verify string"
    lego = spark.createDataFrame(chains, names)
    for task in ("steps", "direct", "path", "verify_steps"):
        made = lego_examples(lego, task, "teacherforcing", opts, "validation").collect()
        out = lego_rejected(lego, task).collect()
        assert sorted([r.id for r in made] + [r.id for r in out]) == [1, 2, 3, 4]
        assert all(v is not None for r in made for v in r)


def test_a_sequence_of_one_position_counts_as_right(spark):
    from seqprep.operators.metrics import train_seq_acc

    rows = [(1, 0, [1.0, 0.0], 1), (2, 0, [1.0, 0.0], -1), (2, 1, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "seq bigint, pos int, v array<double>, label int")
    assert train_seq_acc(df).first().value == 0.5
