"""The registered queries: one per operator, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from seqprep.functions import tokens as tok
from seqprep.functions import vectors as vec
from seqprep.operators import collate, lego, metrics, objectives, ordering, packing
from seqprep.operators import preference, shortest
from seqprep.options import PrepOptions
from seqprep.plans import workflows
from seqprep.sources import files
from seqprep.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

V1 = tok.vocab_of("numeral-v1")
V0 = tok.vocab_of("numeral-v0")
LEGO = tok.vocab_of("lego")
EOS = V1.eos_id
STAR_BLOCK = 256
CORPUS_BLOCK = 4096
OPTS = PrepOptions(noisy_target=0.5, mixtask_ratio=0.4, seed=views.SEED)
OPTS_V0 = PrepOptions(noisy_target=0.5, mixtask_ratio=0.4, seed=views.SEED, variant="v0")
EXAMPLE_SCHEMA = "id bigint, text string, len_target int, wrong_path array<string>"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def words(array: Column | str) -> Column:
    """An array as one string, so that engines compare it alike."""
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(array.cast("array<string>"), " ", "_")


def flat(df: DataFrame, *arrays: str) -> DataFrame:
    """Turn id arrays into strings and whole numbers into bigint."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            words(c).alias(c)
            if kinds[c].startswith("array")
            else F.col(c).cast("bigint").alias(c)
            if kinds[c] == "int"
            else F.col(c)
            for c in df.columns
        ]
    )


# ---- sources, order, splits ---------------------------------------------------------------


def _scored_parts(parts: dict[str, DataFrame]) -> DataFrame:
    return metrics.union_batches([p.withColumn("split", F.lit(s)) for s, p in parts.items()])


@query
def load_csv(spark, sf_dir):
    path = files.scratch_dir(spark) + "/star.csv"
    table = views.star(spark, sf_dir).select("id", "text", "len_target")
    table.write.csv(path, header=True, escape='"')
    parts = files.load(spark, path, order_by="id", schema="id bigint, text string, len_target int")
    return flat(_scored_parts(parts))


@query
def load_json(spark, sf_dir):
    path = files.scratch_dir(spark) + "/star.json"
    views.star(spark, sf_dir).write.json(path)
    parts = files.load(spark, path, order_by="id", pct=10, schema=EXAMPLE_SCHEMA)
    return _scored_parts(parts).select(
        "id", "text", F.col("len_target").cast("bigint"), F.array_join("wrong_path", ";").alias("wrong"),
        "split",
    )


@query
def load_text_split(spark, sf_dir):
    """A text file without ids: rows get their place, and are split and built."""
    path = files.scratch_dir(spark) + "/star.txt"
    rows = views.star(spark, sf_dir).select("id", "text").orderBy("id")
    rows.select("text").write.text(path)  # sorted parts have ascending names
    parts = files.load(spark, path, order_by="id")
    made = [
        objectives.examples(p, "teacherforcing", OPTS, "train").withColumn("split", F.lit(s))
        for s, p in parts.items()
    ]
    return flat(metrics.union_batches(made))


@query
def load_csv_plain(spark, sf_dir):
    """A csv file without ids."""
    path = files.scratch_dir(spark) + "/star.csv"
    rows = views.star(spark, sf_dir).select("id", "text", "len_target").orderBy("id")
    rows.drop("id").write.csv(path, header=True, escape='"')
    parts = files.load(spark, path, order_by="id", schema="text string, len_target int")
    return flat(_scored_parts(parts))


@query
def load_text(spark, sf_dir):
    path = files.scratch_dir(spark) + "/star.txt"
    views.star(spark, sf_dir).select("text").write.text(path)
    return files.load(spark, validation=path)["validation"]


@query
def load_dir(spark, sf_dir):
    path = files.scratch_dir(spark) + "/star"
    files.save_dir(ordering.head_parts(files.staged(views.star(spark, sf_dir)), "id", 5), path)
    parts = files.load_dir(spark, path)
    return flat(_scored_parts(parts).select("id", "text", "len_target", "split"))


@query
def row_index(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    return ordering.with_row_index(docs, ["source", "doc_id"]).select("doc_id", "row_idx")


@query
def head_split(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ordering.head_split(docs, "doc_id", 5)


@query
def cap_rows(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ordering.cap(docs, 100, "doc_id")


@query
def sample_rows(spark, sf_dir):
    return ordering.sample_rows(
        views.star(spark, sf_dir).select("id", "text"), "id", 3, views.SEED
    )


@query
def sample_decoded(spark, sf_dir):
    picked = ordering.sample_rows(views.star(spark, sf_dir), "id", 3, views.SEED)
    return objectives.generation_examples(picked, OPTS_V0).select(
        "id",
        tok.decode(F.col("input_ids"), V0).alias("prompt"),
        tok.decode(F.col("targets"), V0).alias("target"),
    )


@query
def split_counts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id")
    return ordering.split_counts(ordering.head_split(docs, "doc_id", 5), {"train": 500})


@query
def row_index_ranges(spark, sf_dir):
    """Row positions by many small ranges."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    made = ordering.with_row_index(docs, ["source", "doc_id"], rows_per_range=50)
    return made.select("doc_id", "row_idx")


# ---- text, tokens, ids --------------------------------------------------------------------


@query
def split_prompt_target(spark, sf_dir):
    accepted, _ = tok.split_prompt_target(views.star(spark, sf_dir), "text")
    return accepted.select("id", "prompt", "target")


@query
def split_rejects(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    _, rejects = tok.split_prompt_target(docs, "text")
    return rejects.select("doc_id", F.col("n_parts").cast("bigint"))


@query
def lego_split(spark, sf_dir):
    accepted, _ = tok.split_prompt_target(views.lego(spark, sf_dir), "symbol_text", "?")
    return accepted.select("id", "prompt", "target")


@query
def tokenize(spark, sf_dir):
    """Every token list of every whole document, as a digest and its ends."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", tok.tokenize(F.col("text")).alias("t")).select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("t", "\x01")).alias("tokens_md5"),
        F.try_element_at("t", F.lit(1)).alias("first_token"),
        F.try_element_at("t", F.lit(-1)).alias("last_token"),
    )


@query
def token_counts(spark, sf_dir):
    return views.corpus(spark, sf_dir).select("doc_id", "n_tokens")


def _vocab_use(spark: SparkSession, rows: DataFrame, text: str, vocab: tok.Vocab) -> DataFrame:
    """Vocabulary entries with how often the column uses them (0 included)."""
    used = (
        rows.select(F.explode(tok.tokenize(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        vocab.frame(spark)
        .join(used, "token", "left")
        .select("token", F.col("id").cast("bigint"), F.coalesce("n", F.lit(0)).alias("n_used"))
    )


@query
def vocab_numeral_v1(spark, sf_dir):
    return _vocab_use(spark, views.table(spark, sf_dir, "documents"), "text", V1)


@query
def vocab_numeral_v0(spark, sf_dir):
    return _vocab_use(spark, views.star(spark, sf_dir), "text", V0)


@query
def vocab_lego(spark, sf_dir):
    return _vocab_use(spark, views.lego(spark, sf_dir), "symbol_text", LEGO)


@query
def encode_ids(spark, sf_dir):
    return flat(
        views.star(spark, sf_dir).select("id", tok.encode(F.col("text"), V1).alias("ids"))
    )


@query
def oov_rate(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return tok.oov_rate(docs, "text", V1, "source").withColumn(
        "unknown_share", F.round("unknown_share", 6)
    )


@query
def decode_tokens(spark, sf_dir):
    ids = tok.encode(F.col("text"), V1)
    return views.star(spark, sf_dir).select("id", words(tok.ids_to_tokens(ids, V1)).alias("tokens"))


@query
def detokenize_numeral(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", tok.decode(tok.encode(F.col("text"), V1), V1).alias("decoded")
    )


@query
def detokenize_lego(spark, sf_dir):
    rows = views.lego(spark, sf_dir)
    return rows.select("id", tok.decode(tok.encode(F.col("symbol_text"), LEGO), LEGO).alias("decoded"))


@query
def roundtrip_audit(spark, sf_dir):
    rows = views.lego(spark, sf_dir).select("id", "symbol_text")
    return tok.roundtrip_audit(rows, "symbol_text", V1).select("id", "decoded")


@query
def with_bos(spark, sf_dir):
    accepted, _ = tok.split_prompt_target(views.star(spark, sf_dir), "text")
    encoded = accepted.select(
        "id", tok.encode(F.col("prompt"), V1).alias("p"), tok.encode(F.col("target"), V1).alias("t")
    )
    return flat(
        encoded.select(
            "id",
            tok.with_bos(F.col("p"), bos_id=EOS, add_bos=True).alias("single"),
            tok.with_bos(F.col("p"), F.col("t"), bos_id=EOS, add_bos=True).alias("pair"),
            tok.with_bos(F.col("p"), F.col("t"), bos_id=EOS, add_bos=False).alias("bare"),
        )
    )


@query
def special_mask(spark, sf_dir):
    accepted, _ = tok.split_prompt_target(views.star(spark, sf_dir), "text")
    encoded = accepted.select(
        "id", tok.encode(F.col("prompt"), V1).alias("p"), tok.encode(F.col("target"), V1).alias("t")
    )
    return flat(
        encoded.select(
            "id",
            tok.special_mask(F.col("p"), add_bos=True).alias("single"),
            tok.special_mask(F.col("p"), F.col("t"), add_bos=True).alias("pair"),
            tok.special_mask(F.col("p"), F.col("t"), add_bos=False).alias("bare"),
        )
    )


@query
def node_set(spark, sf_dir):
    ids = tok.encode(F.col("text"), V1)
    return flat(
        views.table(spark, sf_dir, "documents").select(
            "doc_id", tok.node_set(ids, V1.nodes).alias("nodes")
        )
    )


@query
def prefix_space(spark, sf_dir):
    spaced = tok.prefix_space(F.col("text"))
    return flat(views.star(spark, sf_dir).select("id", tok.encode(spaced, V1).alias("ids")))


# ---- path-finding examples ----------------------------------------------------------------


def _train(objective: str, opts: PrepOptions = OPTS) -> Query:
    return lambda spark, sf_dir: flat(
        objectives.examples(views.star(spark, sf_dir), objective, opts, "train")
    )


def _validation(objective: str, opts: PrepOptions = OPTS) -> Query:
    def run(spark, sf_dir):
        rows = views.star(spark, sf_dir)
        longest = objectives.max_target_length(views.star_lengths(spark, sf_dir)) if opts.variant == "v1" else None
        return flat(objectives.examples(rows, objective, opts, "validation", longest))

    return run


QUERIES.update(
    {
        "ex_teacherforcing": _train("teacherforcing"),
        "ex_reverse": _train("reverse"),
        "ex_teacherless": _train("teacherless"),
        "ex_noisyguide": _train("noisyguide"),
        "ex_noisytarget": _train("noisytarget"),
        "ex_mixtask_v1": _train("mixtask"),
        "ex_mixtask_v1_val": _validation("mixtask"),
        "ex_mixtask_v0": _train("mixtask", OPTS_V0),
        "ex_mixtask_v0_val": _validation("mixtask", OPTS_V0),
        "ex_fit_prefix": _train("fit_prefix"),
        "ex_improving": _train("improving"),
        "ex_improving_val": _validation("improving"),
        "ex_error_detection": _train("error_detection"),
        "ex_error_detection_val": _validation("error_detection"),
        "ex_step_eval": _train("step_eval"),
        "ex_step_eval_val": _validation("step_eval"),
        "ex_reverse_val": _validation("reverse"),
        "ex_validation_v1": _validation("teacherforcing"),
        "ex_validation_v0": _validation("teacherforcing", OPTS_V0),
        "ex_teacherforcing_v0": _train("teacherforcing", OPTS_V0),
        "ex_teacherless_v0": _train("teacherless", OPTS_V0),
        "ex_noisyguide_v0": _train("noisyguide", OPTS_V0),
        "ex_noisytarget_v0": _train("noisytarget", OPTS_V0),
    }
)


@query
def ex_generation(spark, sf_dir):
    return flat(objectives.generation_examples(views.star(spark, sf_dir), OPTS_V0))


@query
def rejects_step_eval(spark, sf_dir):
    """Rows left out for want of a wrong path: here those whose target has an even length."""
    paths = F.when(F.col("len_target") % 2 == 1, F.col("wrong_path"))
    rows = views.star(spark, sf_dir).withColumn("wrong_path", paths)
    return objectives.rejected(rows, "step_eval", OPTS, "train")


def malformed(rows):
    """The lines of two ids in seven spoilt: without a separator, or with one too many."""
    spoilt = F.when(F.col("id") % 7 == 0, F.replace("text", F.lit("="), F.lit(""))).when(
        F.col("id") % 7 == 1, F.concat("text", F.lit("=1"))
    )
    return rows.withColumn("text", F.coalesce(spoilt, "text"))


@query
def rejects_error_detection(spark, sf_dir):
    """Lines left out of error detection: malformed, or without a place or a node to alter."""
    rows = malformed(views.star(spark, sf_dir))
    return objectives.rejected(rows, "error_detection", OPTS, "validation")


@query
def ex_malformed(spark, sf_dir):
    """Error-detection rows of a table with malformed lines."""
    rows = malformed(views.star(spark, sf_dir))
    longest = objectives.max_target_length(views.star_lengths(spark, sf_dir))
    return flat(objectives.examples(rows, "error_detection", OPTS, "validation", longest))


@query
def preference_pairs(spark, sf_dir):
    return preference.preference_pairs(views.star(spark, sf_dir)).select(
        "id", "text", "prompt", "chosen", "rejected"
    )


@query
def preference_distinct(spark, sf_dir):
    pairs = preference.preference_pairs(views.star(spark, sf_dir), drop_equal=True)
    return pairs.select("id", "prompt", "chosen", "rejected")


@query
def max_target_length(spark, sf_dir):
    rows = views.star(spark, sf_dir).select("id", "len_target")
    return objectives.target_lengths(*ordering.head_parts(rows, "id").values())


@query
def preference_max_length(spark, sf_dir):
    rows = files.staged(views.star(spark, sf_dir))
    pairs = preference.preference_pairs(rows)
    return preference.length_budget(pairs, "id", objectives.target_lengths(rows))


# ---- lego and shortest-path examples ------------------------------------------------------


def _lego(task: str, objective: str = "teacherforcing", split: str = "train") -> Query:
    return lambda spark, sf_dir: flat(
        lego.lego_examples(views.lego(spark, sf_dir), task, objective, OPTS, split)
    )


@query
def lego_noisy(spark, sf_dir):
    rows = views.lego(spark, sf_dir)
    made = [
        lego.lego_examples(rows, task, "noisytarget", OPTS, "train").withColumn("task", F.lit(task))
        for task in ("path", "steps")
    ]
    return flat(metrics.union_batches(made))


@query
def lego_examples(spark, sf_dir):
    return _lego("path", split="validation")(spark, sf_dir)


@query
def lego_extract(spark, sf_dir):
    rows = views.lego(spark, sf_dir, joiner=":")
    return flat(lego.lego_extract(rows, OPTS_V0, "train", "symbol_text"))


def _shortest(objective: str, split: str = "train", aug: str = "none") -> Query:
    return lambda spark, sf_dir: flat(
        shortest.shortest_examples(views.shortest(spark, sf_dir), objective, OPTS, split, aug)
    )


QUERIES.update(
    {
        "lego_steps": _lego("steps"),
        "lego_direct": _lego("direct"),
        "lego_path": _lego("path"),
        "lego_verify": _lego("verify_steps"),
        "sp_teacherforcing": _shortest("teacherforcing"),
        "sp_step_eval": _shortest("step_eval"),
        "sp_pause": _shortest("pause"),
        "sp_aug_padding": _shortest("teacherforcing", aug="padding"),
        "sp_validation": _shortest("step_eval", split="validation"),
    }
)


# ---- packing and padding ------------------------------------------------------------------


@query
def pack_assign(spark, sf_dir):
    counted = files.staged(views.corpus(spark, sf_dir).select("doc_id", "n_tokens"))
    assigned = packing.pack_assign(counted, "doc_id", F.col("n_tokens"), CORPUS_BLOCK)
    return assigned.select("doc_id", "length", "batch_id", F.col("chunk").cast("bigint"))


@query
def pack_assign_ranges(spark, sf_dir):
    """The same by many small ranges."""
    counted = files.staged(views.corpus(spark, sf_dir).select("doc_id", "n_tokens"))
    assigned = packing.pack_assign(
        counted, "doc_id", F.col("n_tokens"), CORPUS_BLOCK, rows_per_range=100
    )
    return assigned.select("doc_id", "length", "batch_id", F.col("chunk").cast("bigint"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = objectives.examples(views.star(spark, sf_dir), "teacherforcing", OPTS, "train")
    return packing.pack(files.staged(made), "id", STAR_BLOCK)


@query
def pack_chunks(spark, sf_dir):
    return flat(_packed(spark, sf_dir))


@query
def pack_fill(spark, sf_dir):
    made = objectives.examples(views.star(spark, sf_dir), "teacherforcing", OPTS, "train")
    lengths = files.staged(made.select("id", F.size("input_ids").alias("n")))
    chunks = packing.chunk_sizes(lengths, "id", F.col("n"), STAR_BLOCK)
    return packing.pack_fill(chunks, STAR_BLOCK, F.col("length")).withColumn(
        "mean_fill", F.round("mean_fill", 6)
    )


def _padded(side: str, **how) -> Query:
    def run(spark, sf_dir):
        made = objectives.examples(views.star(spark, sf_dir), "teacherforcing", OPTS, "train")
        return flat(collate.pad(made, side=side, pad_id=EOS, **how))

    return run


QUERIES.update(
    {
        "pad_left": _padded("left", length=72),
        "pad_right": _padded("right", length=72),
        "pad_multiple": _padded("right", strategy="longest", multiple=8),
    }
)


@query
def batch_pad(spark, sf_dir):
    made = objectives.generation_examples(views.star(spark, sf_dir), OPTS_V0)
    return flat(collate.batch_pad(files.staged(made), "id", 256, "left", V0.eos_id))


@query
def ragged_batches(spark, sf_dir):
    made = objectives.generation_examples(views.star(spark, sf_dir), OPTS_V0)
    return flat(collate.ragged_batches(files.staged(made), "id", 256, ["input_ids", "targets"]))


@query
def batch_pad_ranges(spark, sf_dir):
    """The same by many small ranges."""
    made = objectives.generation_examples(views.star(spark, sf_dir), OPTS_V0)
    return flat(
        collate.batch_pad(files.staged(made), "id", 256, "left", V0.eos_id, rows_per_range=300)
    )


# ---- scores -------------------------------------------------------------------------------


@query
def argmax(spark, sf_dir):
    rows = views.logits(spark, sf_dir)
    return flat(rows.select("seq", "pos", vec.argmax(F.col("v")).alias("pred")))


@query
def correct_mask(spark, sf_dir):
    return flat(metrics.correct_mask(views.preds(spark, sf_dir), "id", EOS))


@query
def seq_acc(spark, sf_dir):
    return metrics.seq_acc(views.preds(spark, sf_dir), EOS).withColumn(
        "value", F.round("value", 6)
    )


@query
def token_acc(spark, sf_dir):
    return flat(
        metrics.token_acc(views.preds(spark, sf_dir), EOS).withColumn(
            "token_acc", F.round("token_acc", 6)
        )
    )


@query
def eval_metrics(spark, sf_dir):
    return metrics.eval_metrics(views.preds(spark, sf_dir), EOS).withColumn(
        "value", F.round("value", 6)
    )


@query
def shift_pairs(spark, sf_dir):
    rows = views.logits(spark, sf_dir).select("seq", "pos", "label")
    return flat(metrics.shift_pairs(rows))


@query
def train_seq_acc(spark, sf_dir):
    return metrics.train_seq_acc(views.logits(spark, sf_dir)).withColumn(
        "value", F.round("value", 6)
    )


@query
def column_acc(spark, sf_dir):
    return flat(
        metrics.column_acc(views.logits(spark, sf_dir)).withColumn(
            "column_acc", F.round("column_acc", 6)
        )
    )


@query
def kth_token_acc(spark, sf_dir):
    return metrics.kth_token_acc(views.logits(spark, sf_dir)).withColumn(
        "kth_acc", F.round("kth_acc", 6)
    )


@query
def masked_nll(spark, sf_dir):
    return metrics.masked_nll(views.logits(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


@query
def perplexity(spark, sf_dir):
    return metrics.perplexity(views.logits(spark, sf_dir)).withColumn(
        "perplexity", F.round("perplexity", 6)
    )


@query
def softmax(spark, sf_dir):
    rows = views.logits(spark, sf_dir).select(
        "seq", "pos", F.posexplode(vec.softmax(F.col("v"))).alias("token", "prob")
    )
    return flat(rows.withColumn("prob", F.round("prob", 6)))


@query
def token_prob(spark, sf_dir):
    rows = views.logits(spark, sf_dir)
    probs = vec.softmax(F.col("v"))
    return flat(
        rows.select(
            "seq",
            "pos",
            "label",
            F.coalesce(F.round(vec.token_prob(probs, F.col("label")), 6), F.lit(-1.0)).alias(
                "label_prob"
            ),
            F.round(vec.token_prob(probs, vec.argmax(F.col("v"))), 6).alias("pred_prob"),
        )
    )


@query
def topk_tokens(spark, sf_dir):
    """The three best tokens at the first generated position of each sequence."""
    generated = views.logits(spark, sf_dir).filter(F.col("label") != -1)
    first = generated.groupBy("seq").agg(F.min_by("v", "pos").alias("v"))
    best = first.select("seq", vec.topk_tokens(vec.softmax(F.col("v"))).alias("best"))
    return flat(
        best.select("seq", F.posexplode("best").alias("rank", "b")).select(
            "seq", "rank", F.col("b.token").alias("token"), F.round("b.value", 6).alias("prob")
        )
    )


@query
def union_batches(spark, sf_dir):
    """Predictions scored part by part and stacked again."""
    parts = ordering.head_parts(files.staged(views.preds(spark, sf_dir)), "id", 50)
    scored = [
        metrics.correct_mask(p, "id", EOS).groupBy("id").agg(F.sum("correct").alias("n_correct"))
        for p in parts.values()
    ]
    return metrics.union_batches(scored)


@query
def tail_slice(spark, sf_dir):
    """Generated ids cut off the end of whole output sequences."""
    rows = views.preds(spark, sf_dir)
    prompts = objectives.generation_examples(views.star(spark, sf_dir), OPTS)
    outputs = prompts.join(rows, "id").select(
        "id", F.concat("input_ids", "preds").alias("sequence"), "labels"
    )
    return flat(
        outputs.select(
            "id", vec.tail_slice(F.col("sequence"), F.size("labels")).alias("generated")
        )
    )


@query
def metric_flush(spark, sf_dir):
    return metrics.metric_flush(views.metric_log(spark, sf_dir)).withColumn(
        "value", F.round("value", 6)
    )


@query
def metric_flush_ranges(spark, sf_dir):
    """The same by many small ranges."""
    found = metrics.metric_flush(views.metric_log(spark, sf_dir), rows_per_range=100)
    return found.withColumn("value", F.round("value", 6))


# ---- streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    base = files.scratch_dir(spark)
    rows.write.parquet(f"{base}/in")
    return streams.load_stream(spark, f"{base}/in", "parquet", rows.schema), base


def _streamed(spark: SparkSession, rows: DataFrame, objective: str, opts: PrepOptions, kind: str) -> DataFrame:
    stream, base = _stream(spark, rows)
    made = streams.stream_examples(stream, objective, opts, kind)
    streams.write_stream(made, f"{base}/out", f"{base}/state").awaitTermination()
    return flat(spark.read.parquet(f"{base}/out"))


@query
def stream_equals_batch(spark, sf_dir):
    return _streamed(spark, views.star(spark, sf_dir), "teacherforcing", OPTS, "star")


@query
def stream_lego(spark, sf_dir):
    opts = PrepOptions(task="path", seed=views.SEED)
    return _streamed(spark, views.lego(spark, sf_dir), "teacherforcing", opts, "lego")


@query
def stream_shortest(spark, sf_dir):
    return _streamed(spark, views.shortest(spark, sf_dir), "step_eval", OPTS, "shortest")


@query
def stream_pack(spark, sf_dir):
    rows, base = _stream(spark, views.star(spark, sf_dir))
    made = streams.stream_examples(rows, "teacherforcing", OPTS)
    streams.pack_stream(made, "id", STAR_BLOCK, f"{base}/out", f"{base}/state").awaitTermination()
    return flat(spark.read.parquet(f"{base}/out").drop("epoch"))


# ---- whole jobs ---------------------------------------------------------------------------


def _job(spark: SparkSession, sf_dir: str, **options):
    """The path-finding job on a JSON table of the star view."""
    base = files.scratch_dir(spark)
    views.star(spark, sf_dir).write.json(f"{base}/star.json")
    opts = PrepOptions(train_file=f"{base}/star.json", seed=views.SEED, **options)
    return workflows.prepare_star(spark, opts, f"{base}/out")


@query
def stream_job(spark, sf_dir):
    """Training rows of the job that reads its source as a stream, split by head."""
    return flat(_job(spark, sf_dir, streaming=True)["train"])


@query
def job_counts(spark, sf_dir):
    """Raw and written rows of a job with caps, counted while they are written."""
    return _job(spark, sf_dir, max_train_samples=1000, validation_pct=10).counts


def _generation(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The scoring job on the generated view; label 0 takes the place of the end token."""
    return workflows.score_generation(views.generated(spark, sf_dir), 0, "seq", out=files.scratch_dir(spark))


@query
def generation_rows(spark, sf_dir):
    """Every answered token with its probability, the likeliest first tokens and the first label's."""
    rows = _generation(spark, sf_dir)["rows"]
    kinds = {
        "token": F.arrays_zip(F.col("preds").alias("token"), F.col("probs").alias("prob")),
        "best": F.transform("best", lambda b: F.struct(b["token"].alias("token"), b["value"].alias("prob"))),
        "label": F.array(F.struct(F.element_at("labels", 1).alias("token"), F.col("label_prob").alias("prob"))),
    }
    parts = [
        rows.select("seq", F.lit(kind).alias("kind"), F.posexplode(entries).alias("place", "e"))
        for kind, entries in kinds.items()
    ]
    made = metrics.union_batches(parts)
    return flat(
        made.select("seq", "kind", "place", F.col("e.token").alias("token"), F.round("e.prob", 6).alias("prob"))
    )


@query
def generation_metrics(spark, sf_dir):
    """Accuracies saved by the scoring job, from the rows that it wrote."""
    return _generation(spark, sf_dir)["metrics"].withColumn("value", F.round("value", 6))
