"""Readers, writers, option checks and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from seqprep.functions.tokens import vocab_of
from seqprep.operators import objectives, packing
from seqprep.options import PrepOptions, block_size, validate_options
from seqprep.plans import workflows
from seqprep.sources import files
from seqprep.streaming import streams

SCHEMA = "id long, text string, len_target int, wrong_path array<string>"


def rows(df):
    return sorted(map(str, df.collect()))


def test_csv_keeps_quotes_and_commas(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b",c'), (2, "1,2=3")], "id long, text string")
    path = str(tmp_path / "x.csv")
    df.write.csv(path, header=True, escape='"')
    assert rows(files.read_file(spark, path, "id long, text string")) == rows(df)
    assert files.read_file(spark, path).count() == 2


def test_csv_line_breaks_inside_fields(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,text\n1,"a\nb"\n')
    read = files.read_file(spark, str(path), "id long, text string", multiline=True)
    assert [tuple(r) for r in read.collect()] == [(1, "a\nb")]


def test_json(spark, star_table, tmp_path):
    path = str(tmp_path / "x.json")
    star_table.write.json(path)
    parts = files.load(spark, path, order_by="id", schema=SCHEMA)
    assert rows(parts["train"].unionAll(parts["validation"])) == rows(star_table)


def test_text(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("a\n b\n")
    assert {r.text for r in files.load_text(spark, str(path)).collect()} == {"a\n", " b\n"}
    assert {r.text for r in files.load_text(spark, str(path), False).collect()} == {"a", " b"}


def test_two_files(spark, tmp_path):
    for name, text in (("t", "1=2\n"), ("v", "3=4\n")):
        (tmp_path / f"{name}.txt").write_text(text)
    parts = files.load(spark, str(tmp_path / "t.txt"), str(tmp_path / "v.txt"))
    assert parts["validation"].first().text == "3=4\n"
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "t.txt"))
    with pytest.raises(ValueError):
        files.load(spark)
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "t.parquet"))


def test_saved_dataset(spark, star_table, tmp_path):
    path = str(tmp_path / "star")
    files.save_dir({"train": star_table}, path)
    assert set(files.load_dir(spark, path)) == {"train"}
    files.save_dir({"validation": star_table.limit(3)}, path)
    assert files.load_dir(spark, path)["validation"].count() == 3
    star_table.write.parquet(str(tmp_path / "plain"))
    assert rows(files.load_dir(spark, str(tmp_path / "plain"))["train"]) == rows(star_table)
    assert files.task_name(path + "/") == "star"


def test_named_table(spark, star_table):
    star_table.write.mode("overwrite").saveAsTable("graphs_small")
    parts = files.load_named(spark, "graphs", "small", order_by="id", pct=10)
    assert parts["validation"].count() == round(star_table.count() / 10)
    marked = star_table.withColumn(
        "split", F.when(F.col("id") % 4 == 0, "validation").otherwise("train")
    )
    marked.write.mode("overwrite").saveAsTable("graphs_marked")
    parts = files.load_named(spark, "graphs_marked")
    assert parts["train"].columns == star_table.columns
    assert parts["validation"].count() == marked.filter("split = 'validation'").count()


def test_text_column(spark):
    assert files.text_column(spark.createDataFrame([("a", "b")], "x string, text string")) == "text"
    assert files.text_column(spark.createDataFrame([("a", "b")], "x string, y string")) == "x"


def test_prepared_is_reused(spark, tmp_path):
    path = str(tmp_path / "p")
    assert files.prepared(spark.range(3), path).count() == 3
    assert files.prepared(spark.range(5), path).count() == 3
    assert files.prepared(spark.range(5), path, overwrite=True).count() == 5


def test_half_written_table_is_written_again(spark, tmp_path):
    path = tmp_path / "p"
    spark.range(3).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert files.prepared(spark.range(5), str(path)).count() == 5


def test_metric_and_vocab_sinks(spark, tmp_path):
    preds = spark.createDataFrame([([1], [1])], "preds array<int>, labels array<int>")
    scored = workflows.score(preds, "numeral-v1", str(tmp_path / "m"))
    assert {r.metric: r.value for r in scored.collect()}["seq_acc"] == 1.0
    files.save_vocab(spark, vocab_of("lego"), str(tmp_path / "v"))
    lines = [
        json.loads(x) for f in (tmp_path / "v").glob("*.json") for x in f.read_text().splitlines()
    ]
    assert lines == sorted(lines, key=lambda r: r["token"]) and len(lines) == 37
    assert {r["token"]: r["id"] for r in lines} == vocab_of("lego").symbol_ids()


@pytest.mark.parametrize(
    "bad",
    [
        {},
        {"train_file": "x.parquet"},
        {"dataset_name": "x", "teacherless": True, "reverse": True},
        {"dataset_name": "x", "teacherless": True, "noisy_target": 0.1},
        {"dataset_name": "x", "reverse": True, "noisy_target": 0.1},
        {"dataset_name": "x", "objective": "step_eval_short"},
        {"dataset_name": "x", "objective": "fit_prefix", "variant": "v0"},
        {"dataset_name": "x", "objective": "noisyguide", "alter_label": True},
        {"dataset_name": "x", "variant": "v7"},
        {"dataset_name": "x", "task": "other"},
        {"dataset_name": "x", "aug": "other"},
    ],
)
def test_bad_options(bad):
    with pytest.raises(ValueError):
        validate_options(PrepOptions(**bad))


def test_good_options():
    assert validate_options(PrepOptions(train_file="x.csv")).vocab.size == 70
    a, b = PrepOptions(dataset_name="x"), PrepOptions(dataset_name="x", seed=1)
    assert a.fingerprint() != b.fingerprint()


@pytest.mark.parametrize(
    "option, tokenizer_max, limit, size",
    [
        (512, 2048, None, 512), (4096, 2048, None, 2048), (None, 800, None, 800),
        (None, 10**30, None, 1024), (None, 10**30, 2048, 1024), (None, 10**30, 512, 512),
        (None, 2048, 2048, 2048), (None, 2048, -1, 1024),
    ],
)
def test_block_size(option, tokenizer_max, limit, size):
    assert block_size(option, tokenizer_max, limit) == size


@pytest.mark.parametrize("objective", ["teacherforcing", "improving", "step_eval"])
def test_stream_equals_batch(spark, star_table, tmp_path, objective):
    star_table.repartition(5).write.parquet(str(tmp_path / "in"))
    opts = PrepOptions()
    stream = streams.load_stream(spark, str(tmp_path / "in"), "parquet", SCHEMA, max_files=2)
    made = streams.stream_examples(stream, objective, opts)
    streams.write_stream(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = objectives.examples(star_table, objective, opts, "train")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)


def test_stream_packing_keeps_every_row(spark, star_table, tmp_path):
    star_table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.load_stream(spark, str(tmp_path / "in"), "parquet", SCHEMA, max_files=1)
    made = streams.stream_examples(stream, "teacherforcing", PrepOptions())
    out = str(tmp_path / "out")
    streams.pack_stream(made, "id", 128, out, str(tmp_path / "cp")).awaitTermination()
    packed = spark.read.parquet(out)
    batch = objectives.examples(star_table, "teacherforcing", PrepOptions(), "train")
    total = batch.agg(F.sum(F.size("input_ids"))).first()[0]
    assert packed.agg(F.sum(F.size("input_ids"))).first()[0] == total
    assert packed.agg(F.sum("n_rows")).first()[0] == star_table.count()
    assert packed.select("epoch").distinct().count() == 4
    assert packed.agg(F.max(F.size("input_ids"))).first()[0] <= 128


@pytest.mark.parametrize("fmt", ["json", "csv", "text"])
def test_stream_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1=2",), ("3=4",)], "text string")
    writer = df.write.option("header", True)
    getattr(writer, fmt)(str(tmp_path / "in"))
    stream = streams.load_stream(spark, str(tmp_path / "in"), fmt, "text string")
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)
    with pytest.raises(ValueError):
        streams.load_stream(spark, "x", "xml", "text string")


def test_star_job(spark, star_table, tmp_path):
    path = str(tmp_path / "star.json")
    star_table.write.json(path)
    opts = PrepOptions(train_file=path, max_train_samples=100, variant="v0")
    made = workflows.prepare_star(spark, opts, str(tmp_path / "out"))
    held = math.floor(star_table.count() * 0.05 + 0.5)
    assert made["train"].count() == 100 and made["validation"].count() == held
    again = workflows.prepare_star(spark, opts, str(tmp_path / "out"))
    assert rows(again["train"]) == rows(made["train"])


@pytest.mark.parametrize("kind", ["json", "txt"])
def test_star_job_without_ids(spark, star_table, tmp_path, kind):
    """Files in exactly the schema the job is made for: no row has an id."""
    path = str(tmp_path / f"star.{kind}")
    rows_in = star_table.orderBy("id").drop("id").coalesce(1)
    if kind == "json":
        rows_in.write.json(path)
        opts = PrepOptions(train_file=path, variant="v0")
        made = workflows.prepare_star(spark, opts, str(tmp_path / "out"))
        held = math.floor(star_table.count() * 0.05 + 0.5)
        assert made["validation"].count() == held
        assert sorted(r.id for r in made["validation"].collect()) == list(range(held))
    else:
        rows_in.select("text").write.text(path)
        made = files.load(spark, path, order_by="id", keep_linebreaks=False)
        texts = [r.text for r in star_table.orderBy("id").collect()]
        found = sorted((r.id, r.text) for p in made.values() for r in p.collect())
        assert found == list(enumerate(texts))


def test_file_index_follows_files_and_lines(spark, tmp_path):
    for name, n in (("b", 3), ("a", 5), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    made = files.with_file_index(spark.read.text(str(tmp_path)), "n")
    assert [r.value for r in made.orderBy("n").collect()] == [
        *[f"a{i}" for i in range(5)], *[f"b{i}" for i in range(3)]
    ]
    assert sorted(r.n for r in made.collect()) == list(range(8))


def test_reuse_depends_on_all_that_decides(spark, sf_dir, tmp_path, monkeypatch):
    from checks import views

    raw = files.staged(views.shortest(spark, sf_dir))
    raw = {"train": raw, "validation": raw}
    opts, out = PrepOptions(dataset_name="shortest", block_size=None), str(tmp_path / "out")

    def chunks(tokens):
        made = workflows.prepare_shortest(spark, opts, out, tokens, raw=raw, source="star")
        return made["train"].agg(F.max("n_rows")).first()[0]

    assert chunks(64) < chunks(1000)
    star = files.staged(views.star(spark, sf_dir))
    parts, options = {"train": star, "validation": star.limit(5)}, PrepOptions(dataset_name="star")
    workflows.prepare_star(spark, options, out, parts, source="star")
    pairs = workflows.prepare_preference(spark, options, out, parts, source="star")
    assert "chosen" in pairs.pairs["train"].columns
    fewer = workflows.prepare_preference(spark, options, out, parts, True, source="star")
    equal = pairs.pairs["train"].filter("chosen = rejected").count()
    assert fewer.pairs["train"].count() == pairs.pairs["train"].count() - equal
    # A hit builds and stages nothing; tables without a name are built anew.
    monkeypatch.setattr(workflows, "staged", lambda df: pytest.fail("staged"))
    monkeypatch.setattr(workflows, "load_raw", lambda *a: pytest.fail("loaded"))
    assert chunks(64) and workflows.prepare_star(spark, options, out, parts, source="star")
    half = {"train": star.limit(3), "validation": star.limit(2)}
    assert workflows.prepare_star(spark, options, out, half)["train"].count() == 3


@pytest.mark.parametrize("kind", ["lego", "shortest"])
def test_other_streams_equal_batches(spark, sf_dir, tmp_path, kind):
    from checks import views
    from seqprep.operators.lego import lego_examples
    from seqprep.operators.shortest import shortest_examples

    table = files.staged(getattr(views, kind)(spark, sf_dir))
    opts = PrepOptions(task="path", aug="padding")
    table.write.parquet(str(tmp_path / "in"))
    stream = streams.load_stream(spark, str(tmp_path / "in"), "parquet", table.schema)
    made = streams.stream_examples(stream, "teacherforcing", opts, kind)
    streams.write_stream(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = (
        lego_examples(table, "path", "teacherforcing", opts, "train")
        if kind == "lego"
        else shortest_examples(table, "teacherforcing", opts, "train", "padding")
    )
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    with pytest.raises(ValueError):
        streams.stream_examples(table, "teacherforcing", opts, "other")


def test_table_stream(spark, tmp_path):
    spark.createDataFrame([("1=2",), ("3=4",)], "text string").write.mode("overwrite").saveAsTable("lines_v1")
    stream = streams.stream_table(spark, "lines", "v1")
    streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_generation_scoring(spark):
    rows_in = [(1, [9, 9, 5, 6, 70], [5, 6, 70], [0.0] * 5 + [2.0, 1.0]), (2, [9, 7, 8], [7, 9], [1.0] * 7)]
    df = spark.createDataFrame(rows_in, "id bigint, sequence array<int>, labels array<int>, first array<double>")
    found = workflows.score_generation(df, 70)
    assert {r.metric: r.value for r in found["metrics"].collect()}["seq_acc"] == 0.5
    tokens = {(r.id, r.rank): r.token for r in found["tokens"].collect()}
    assert tokens[1, 0] == 5 and tokens[1, 1] == 6 and tokens[2, 0] == 0
    label = {r.id: r.prob for r in found["label"].collect()}
    assert label[1] == pytest.approx(math.exp(2) / (5 + math.e + math.exp(2))) and label[2] is None


def test_generation_job(spark, tmp_path):
    """The job reads the logits once and scores what it wrote; hostile rows have a defined result."""
    rows_in = [
        (1, [9, 9, 5, 1, 70], [5, 6, 70], [[0.0] * 5 + [2.0, 1.0], [0.0, 1.0]]),  # no vector of the last token
        (2, [8], [7, 9], [[1.0] * 7] * 2),  # shorter than its labels; a token outside the vector
        (3, [4], [], []),
        (4, None, None, None),
    ]
    schema = "id bigint, sequence array<int>, labels array<int>, logits array<array<double>>"
    df = spark.createDataFrame(rows_in, schema)
    found = workflows.score_generation(df, 70, out=str(tmp_path / "scores"))
    assert "logits" not in spark.read.parquet(str(tmp_path / "scores/rows")).columns
    told = {r.id: r for r in found["rows"].collect()}
    first = 5 + math.exp(2) + math.e
    assert told[1].preds == [5, 1, 70]
    assert told[1].probs == pytest.approx([math.exp(2) / first, math.e / (1 + math.e)])
    assert [b.token for b in told[1].best] == [5, 6, 0] and told[1].label_prob == pytest.approx(math.exp(2) / first)
    assert told[2].preds == [8] and told[2].probs == [None] and told[2].label_prob is None
    assert told[3].preds == [] and told[3].best is None and told[4].preds is None
    values = {r.metric: r.value for r in found["metrics"].collect()}
    assert values["seq_acc"] == pytest.approx(1 / 3) and values["token_acc_0"] == pytest.approx(0.5)
    assert spark.read.json(str(tmp_path / "scores/metrics")).count() == len(values)
    lazy = workflows.score_generation(df, 70)
    assert sorted(lazy["metrics"].collect()) == sorted(found["metrics"].collect())
    empty = workflows.score_generation(df.limit(0), 70, out=str(tmp_path / "none"))
    assert empty["rows"].count() == 0 and empty["metrics"].count() == 0


def test_shortest_job(spark, sf_dir, tmp_path):
    from checks import views

    raw = {"train": views.shortest(spark, sf_dir), "validation": views.shortest(spark, sf_dir)}
    raw = {name: files.staged(part) for name, part in raw.items()}
    opts = PrepOptions(dataset_name="shortest", objective="step_eval", max_train_samples=5)
    made = workflows.prepare(spark, opts, str(tmp_path / "out"), raw=raw)
    assert made["train"].count() == 5
    assert made["train"].agg(F.max(F.size("input_ids"))).first()[0] <= 2048
    assert made["validation"].filter(F.size("targets") != 50).count() == 0


def test_lego_job(spark, sf_dir, tmp_path):
    from checks import views

    raw = dict.fromkeys(("train", "validation"), views.lego(spark, sf_dir))
    opts = PrepOptions(dataset_name="lego", task="path", max_eval_samples=7)
    made = workflows.prepare(spark, opts, str(tmp_path / "out"), raw=raw)
    assert made["validation"].count() == 7
    assert made["train"].count() == raw["train"].count()


def test_preference_job(spark, star_table, tmp_path):
    raw = {"train": star_table, "validation": star_table.limit(10)}
    opts = PrepOptions(dataset_name="star")
    made = workflows.prepare_preference(spark, opts, str(tmp_path / "out"), raw)
    first = made.pairs["train"].orderBy("id").first()
    longest = star_table.agg(F.max("len_target")).first()[0]
    tokens = len([t for t in objectives.generation_examples(star_table, opts).orderBy("id").first().input_ids])
    assert first.prompt.endswith("=") and made.max_length == tokens + longest


def test_packing_survives_a_retry(spark, star_table):
    """The same chunks whatever the layout of the input."""
    made = objectives.examples(star_table, "teacherforcing", PrepOptions(), "train")
    once = packing.pack(made.repartition(3), "id", 128, rows_per_range=100)
    again = packing.pack(made.repartition(17), "id", 128, rows_per_range=130)
    assert rows(once) == rows(again)


def scratch_folders(spark):
    import os

    base = files.scratch_base(spark)
    return set(os.listdir(base)) if os.path.exists(base) else set()


def test_scratch_goes_with_its_scope(spark):
    before = scratch_folders(spark)
    with files.scratch_scope(spark):
        assert files.staged(spark.range(3)).count() == 3
        with pytest.raises(RuntimeError), files.scratch_scope(spark):
            files.staged(spark.range(3))
            raise RuntimeError
        assert len(scratch_folders(spark) - before) == 1
    assert scratch_folders(spark) == before
    rounds, now = files.Rounds(spark), spark.range(3)
    for _ in range(6):
        now = rounds.staged(now.selectExpr("id + 1 as id"))
        assert len(scratch_folders(spark) - before) <= 2
    assert now.agg(F.min("id")).first()[0] == 6


def test_sweep_removes_old_scratch_only(spark):
    import os
    import time

    kept, old = files.staged(spark.range(2)), files.scratch_dir(spark)
    folder = os.path.dirname(old)
    os.utime(folder, (time.time() - 90_000,) * 2)
    assert files.sweep_scratch(spark) >= 1
    assert not os.path.exists(folder) and kept.count() == 2


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    settings = {"spark.sql.warehouse.dir": "file:/here"}
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: settings.get(k)), sparkContext=context)
    with pytest.raises(ValueError):
        files.scratch_base(session)
    context.master = "local[2]"
    assert files.scratch_base(session) == "file:/here/_scratch"
    settings["spark.checkpoint.dir"], context.master = "hdfs:/shared/", "yarn"
    assert files.scratch_base(session) == "hdfs:/shared/_scratch"


def test_packing_a_stream_leaves_no_scratch(spark, sf_dir, star_table, tmp_path):
    made = objectives.examples(star_table, "teacherforcing", PrepOptions(), "train").limit(400)
    made.repartition(12).write.parquet(str(tmp_path / "in"))
    before = scratch_folders(spark)
    stream = streams.load_stream(spark, str(tmp_path / "in"), "parquet", made.schema, max_files=1)
    streams.pack_stream(stream, "id", 128, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.agg(F.sum("n_rows")).first()[0] == 400 and found.select("epoch").distinct().count() >= 10
    assert scratch_folders(spark) == before


@pytest.mark.parametrize("kind", ["star", "lego", "shortest"])
@pytest.mark.parametrize("caps", [None, 7])
def test_jobs_give_the_same_rows_as_streams(spark, sf_dir, tmp_path, kind, caps):
    from checks import views

    table = getattr(views, kind)(spark, sf_dir)
    path = str(tmp_path / f"{kind}.json")
    table.write.json(path)
    opts = PrepOptions(train_file=path, task="path", validation_pct=10, max_train_samples=caps, max_eval_samples=caps)
    jobs = {
        "star": workflows.prepare_star, "lego": workflows.prepare_lego,
        "shortest": lambda *a: workflows.prepare_shortest(*a, tokenizer_max=256),
    }
    whole = jobs[kind](spark, opts, str(tmp_path / "batch"))
    from dataclasses import replace

    streamed = jobs[kind](spark, replace(opts, streaming=True), str(tmp_path / "stream"))
    for name in ("train", "validation"):
        assert whole[name].columns == streamed[name].columns
        assert rows(whole[name]) == rows(streamed[name])
    assert rows(whole.counts) == rows(streamed.counts)
    counts = {r["split"]: r for r in whole.counts.collect()}
    n = table.count()
    assert sum(r["n_rows"] for r in counts.values()) == n and counts["validation"]["n_rows"] == round(n * 0.1)
    assert all(counts[s]["n_kept"] == whole[s].count() for s in counts)
    assert whole.samples(opts).count() == 3 and all(r["text"] for r in whole.samples(opts).collect())


def test_a_rewritten_file_makes_a_new_table(spark, tmp_path, monkeypatch):
    path = tmp_path / "lines.json"
    line = '{"id": %d, "text": "1,2|2,3/1,3=1,2,3", "len_target": 3, "wrong_path": ["1,3"]}\n'
    path.write_text("".join(line % i for i in range(20)))
    opts, out = PrepOptions(train_file=str(path)), str(tmp_path / "out")
    assert workflows.prepare_star(spark, opts, out)["train"].count() == 19
    path.write_text("".join(line % i for i in range(40)))
    assert workflows.prepare_star(spark, opts, out)["train"].count() == 38
    monkeypatch.setattr(workflows, "load_raw", lambda *a: pytest.fail("loaded"))
    assert workflows.prepare_star(spark, opts, out)["train"].count() == 38


def test_counts_of_caps_that_leave_nothing(spark, tmp_path, star_table):
    raw = {"train": star_table, "validation": star_table.limit(4)}
    opts = PrepOptions(dataset_name="star", max_train_samples=0)
    made = workflows.prepare_star(spark, opts, str(tmp_path / "out"), raw)
    counts = {r["split"]: (r["n_rows"], r["n_kept"]) for r in made.counts.collect()}
    assert counts == {"train": (star_table.count(), 0), "validation": (4, 4)}
