"""Input views in the engine's own schemas, derived from the test tables.

See FIXTURES.md for the recipes. Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqprep.functions import vectors as vec
from seqprep.functions.basics import computed_once
from seqprep.functions.draws import Draws
from seqprep.functions.tokens import encode, token_count, vocab_of
from seqprep.operators.ordering import with_row_index
from seqprep.sources.files import staged

SEGMENT = 12  # order lines of a path at most
SEGMENT_ID = 1 << 40  # between the ids of an order's segments
BLOCK = 100_000  # segments told at a time
PRED_WIDTH = SEGMENT + 1
CHAIN = 8  # vector entries of a chain
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long_segments(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines of the long ``orders`` with their segment: numbered by ranges of the sort key, so an
    order of any size is cut up without meeting in one task. Equal lines are told apart by a count.
    """
    keys = lines.columns
    counted = lines.join(orders, "l_orderkey", "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")
    )
    each = staged(counted.select(*keys, F.explode(F.sequence(F.lit(1), "n")).alias("copy")))
    numbered = with_row_index(each, [*keys, "copy"], "_at")
    firsts = numbered.groupBy("l_orderkey").agg(F.min("_at").alias("_first"))
    segment = F.floor((F.col("_at") - F.col("_first")) / SEGMENT).cast("bigint")
    return numbered.join(firsts, "l_orderkey").select(*keys, segment.alias("segment"))


def _in_order(cut: DataFrame) -> DataFrame:
    """``l_orderkey, segment, lines``: the sorted lines of each segment, each with its nodes and edges.

    Rows move once and are sorted once. A line sees the one before it, and the first one of a segment the
    others. Only lines without a key, which are not cut up, may be more than a segment has.
    """
    node = lambda key: (F.col(key) % 50).cast("string")
    edge = lambda a, b: F.when(F.col("_at") > 1, F.concat_ws(",", a, b))
    in_order = Window.partitionBy("l_orderkey", "segment").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    before = {f"_{k}": F.lag(k).over(in_order) for k in ("l_partkey", "l_suppkey")}
    steps = cut.withColumns({"_at": F.row_number().over(in_order), **before})
    wrong_from = F.when(F.col("_at") == 2, node("_l_partkey")).otherwise(node("_l_suppkey"))
    line = F.struct(
        node("l_partkey").alias("path"),
        node("l_suppkey").alias("tail"),
        edge(node("_l_partkey"), node("l_partkey")).alias("edge"),
        edge(wrong_from, node("l_suppkey")).alias("wrong_edge"),
    )
    steps = steps.withColumn("line", line)
    ahead = F.collect_list("line").over(in_order.rowsBetween(Window.currentRow, SEGMENT - 1))
    keyed = steps.filter(F.col("l_orderkey").isNotNull()).withColumn("lines", ahead)
    kept = ("l_orderkey", "segment", "lines")
    others = steps.filter(F.col("l_orderkey").isNull()).groupBy("l_orderkey", "segment").agg(
        F.sort_array(F.collect_list(F.struct("_at", "line")))["line"].alias("lines")
    )
    return keyed.filter(F.col("_at") == 1).select(*kept).unionByName(others.select(*kept))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph lines from all order lines: ``id, text, len_target, wrong_path``.

    An order of up to 12 lines is one row with the order's number as id. A longer one is cut into
    segments of 12, whose ids are ``SEGMENT_ID`` apart; so a group has 12 lines at most.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    long = staged(sizes.filter(F.col("n") > SEGMENT).select("l_orderkey"))
    whole = lines.join(long, "l_orderkey", "left_anti").withColumn(
        "segment", F.lit(0).cast("bigint")
    )
    cut = whole.unionByName(_long_segments(lines, long))
    orders = _in_order(cut)
    first = F.array(F.element_at("lines.path", 1))
    later = lambda field: F.slice(f"lines.{field}", F.lit(2), F.size("lines") - 1)
    tail, edges = later("tail"), F.array_distinct(F.concat(later("edge"), later("wrong_edge")))
    id_ = F.col("l_orderkey") + F.col("segment") * SEGMENT_ID
    paths = orders.select(
        id_.alias("id"),
        F.coalesce(F.concat(id_.cast("string"), F.lit("|")), F.lit("")).alias("owner"),
        F.col("lines.path").alias("path"),
        F.concat(first, tail).alias("wrong0"),
        F.concat(first, F.reverse(tail)).alias("wrong1"),
        edges.alias("edges"),
    )
    paths = computed_once(paths, edges=F.col("edges"))
    keyed = F.transform("edges", lambda e: F.struct(F.md5(F.concat("owner", e)).alias("k"), e.alias("e")))
    text = F.concat(
        F.array_join(F.sort_array(keyed)["e"], "|"),
        F.lit("/"),
        F.element_at("path", 1),
        F.lit(","),
        F.element_at("path", -1),
        F.lit("="),
        F.array_join("path", ","),
    )
    return computed_once(paths, text=text).select(
        "id",
        "text",
        F.size("path").alias("len_target"),
        F.array(F.array_join("wrong0", ","), F.array_join("wrong1", ",")).alias("wrong_path"),
    )


def star_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, len_target`` of the rows of :func:`star`, from the number of lines of each order alone.

    Lines are neither moved nor sorted for it. The segments of an order are told block by block, so
    that no array grows with it.
    """
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("l_orderkey").isNull(), 0).otherwise(F.expr(f"(n - 1) div {SEGMENT}"))
    blocks = sizes.withColumn("last", last.cast("bigint")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(BLOCK).cast("bigint")))
    )
    end = F.least(F.col("last"), F.col("block") + (BLOCK - 1))
    segments = blocks.withColumn("segment", F.explode(F.sequence("block", end)))
    left = F.col("n") - F.col("segment") * SEGMENT
    length = F.when(F.col("l_orderkey").isNull(), left).otherwise(F.least(left, F.lit(SEGMENT)))
    return segments.select(
        (F.col("l_orderkey") + F.col("segment") * SEGMENT_ID).alias("id"),
        length.cast("int").alias("len_target"),
    )


def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, query, target, steps, trace`` from the star view."""
    parts = F.split("text", "=")
    edges = F.element_at(F.split("text", "/"), 1)
    return star(spark, sf_dir).select(
        "id",
        parts[0].alias("query"),
        parts[1].alias("target"),
        F.replace(edges, F.lit("|"), F.lit(",")).alias("steps"),
        F.split(edges, "[|]").alias("trace"),
    )


def lego(spark: SparkSession, sf_dir: str, joiner: str = ",") -> DataFrame:
    """Signed-variable chains from vectors, one for every eight entries; ``joiner`` separates the
    steps."""
    parts = F.transform(
        F.sequence(F.lit(0), (F.size("embedding") / CHAIN).cast("int") - 1),
        lambda c: F.struct(
            (F.col("vec_id") * CHAIN + c).alias("id"),
            F.slice("embedding", c * CHAIN + 1, F.lit(CHAIN)).alias("e"),
        ),
    )
    chains = table(spark, sf_dir, "embeddings").select(F.inline(parts))
    vec, entries = F.col("id"), range(CHAIN)
    name = lambda i: F.char((F.lit(97) + (vec + 5 * i) % 26).cast("bigint"))
    sign = lambda i: F.when(F.col("e")[i] >= 0, "+").otherwise("-")
    flips = lambda i: sum(
        (F.when(F.col("e")[j] >= 0, 0).otherwise(1) for j in range(i + 1)), F.lit(0)
    )
    named = chains.select(
        "id",
        F.array(*[name(i) for i in entries]).alias("v"),
        F.array(*[sign(i) for i in entries]).alias("s"),
        F.array(*[F.when(flips(i) % 2 == 0, "+1").otherwise("-1") for i in entries]).alias("r"),
    )
    clauses = F.transform(
        F.sequence(F.lit(2), F.lit(CHAIN)),
        lambda i: F.concat(
            F.element_at("v", i), F.lit("="), F.element_at("s", i), F.element_at("v", i - 1)
        ),
    )
    shuffled = F.transform(
        F.sort_array(
            F.transform(
                "clauses",
                lambda c: F.struct(F.md5(F.concat_ws("|", "id", c)).alias("k"), c.alias("c")),
            )
        ),
        lambda x: x["c"],
    )
    steps = F.transform(
        "clauses", lambda c, i: F.concat(c, F.lit("="), F.element_at("r", i + 2))
    )
    made = named.withColumn("clauses", clauses).select(
        "id",
        "v",
        "r",
        F.array_join(shuffled, "|").alias("clauses"),
        F.array_join(steps, joiner).alias("steps"),
        F.concat(
            F.element_at("v", 1), F.lit("="), F.element_at("r", 1), F.lit(","),
            F.element_at("v", CHAIN), F.lit("="),
        ).alias("ask"),
    )
    verdict = F.when(F.col("id") % 2 == 0, "T").otherwise("F")
    return made.select(
        "id",
        F.concat("clauses", F.lit("/"), "ask", F.lit("?"), "steps").alias("symbol_text"),
        F.col("steps").alias("target_steps"),
        F.element_at("r", CHAIN).alias("target_direct"),
        F.array_join("v", ",").alias("target_path"),
        F.concat("steps", F.lit("?"), verdict).alias("target_verify"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their token count."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", token_count(F.col("text")).cast("bigint").alias("n_tokens")
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that miss one position in eight: ``id, preds, labels``."""
    vocab = vocab_of("numeral-v1")
    target = F.split("text", "=")[1]
    ids = encode(target, vocab)
    draws = Draws(SEED, F.col("id"))
    labels = star(spark, sf_dir).select(
        "id",
        F.concat(
            ids, F.array_repeat(F.lit(vocab.eos_id), F.lit(PRED_WIDTH) - F.col("len_target"))
        ).alias("labels"),
    )
    guess = F.transform(
        "labels",
        lambda t, i: F.when(
            draws.uniform("flip", i) < 0.125, draws.below(F.lit(50), "token", i)
        ).otherwise(t),
    )
    return labels.select("id", guess.alias("preds"), "labels")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors per position: ``seq, pos, v, label``."""
    pos = (F.col("vec_id") % 10).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq"),
        pos.alias("pos"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.when(pos < 4, F.lit(-1)).otherwise(F.col("label")).alias("label"),
    )


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's outputs: ``seq, sequence, labels, logits``; positions 4 to 9 of ten are the answer."""
    told = F.struct("pos", vec.argmax(F.col("v")).alias("pred"), "label", "v")
    rows = logits(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(told)).alias("all"))
    answer = F.filter("all", lambda x: x["pos"] >= 4)
    return rows.select(
        "seq", F.col("all.pred").alias("sequence"), F.transform(answer, lambda x: x["label"]).alias("labels"),
        F.transform(answer, lambda x: x["v"]).alias("logits"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values in arrival order: ``seq, split, key, value, is_flush``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("eval").alias("split"),
        F.col("event_type").alias("key"),
        "value",
        (F.col("event_type") == "purchase").alias("is_flush"),
    )
