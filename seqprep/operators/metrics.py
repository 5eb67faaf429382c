"""Scores of predictions and logits.

Prediction tables hold one row per sequence with ``preds`` and ``labels`` arrays. Logit tables
hold one row per position: ``seq, pos, v, label``. Counts are taken inside rows or by partial
aggregates keyed by position, so the data shuffled is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqprep.functions.basics import IGNORE
from seqprep.functions.vectors import argmax, token_nll
from seqprep.operators.ordering import ROWS_PER_RANGE, following, running_total
from seqprep.sources.files import staged

LONGEST = 100_000  # positions of a sequence that one window may hold
FILTER_FROM = 1_000_000  # rows of a logit table from which vectors are filtered before they move
FILTER_KEYS = 8_000_000  # keys of such a filter: 16 MB

# ---- fixed values -------------------------------------------------------------------------
EPSILON = 1e-9  # keeps positions without any counted label defined
# -------------------------------------------------------------------------------------------


def _pairs() -> Column:
    return F.arrays_zip(F.col("preds"), F.col("labels"))


def correct_mask(df: DataFrame, key: str, eos_id: int) -> DataFrame:
    """Long form: ``key, pos, pred, label, mask, correct``; end labels are masked."""
    mask = (F.col("label") != eos_id).cast("int")
    hit = (F.col("pred").eqNullSafe(F.col("label"))).cast("int")
    return (
        df.select(key, F.posexplode(_pairs()).alias("pos", "_pair"))
        .select(
            key, "pos", F.col("_pair.preds").alias("pred"), F.col("_pair.labels").alias("label")
        )
        .withColumn("mask", mask)
        .withColumn("correct", hit * F.col("mask"))
    )


def _row_correct(eos_id: int) -> Column:
    """A sequence is right when no counted position is wrong; an empty mask counts as right."""
    return ~F.exists(
        _pairs(),
        lambda p: (p["labels"] != eos_id) & ~p["preds"].eqNullSafe(p["labels"]),
    )


def seq_acc(df: DataFrame, eos_id: int) -> DataFrame:
    """Share of fully right sequences, as one ``(metric, value)`` row."""
    return df.agg(F.avg(_row_correct(eos_id).cast("double")).alias("value")).select(
        F.lit("seq_acc").alias("metric"), "value"
    )


def token_acc(df: DataFrame, eos_id: int) -> DataFrame:
    """Accuracy per position: ``pos, token_acc``."""
    counted = (F.col("_pair.labels") != eos_id).cast("bigint")
    right = F.col("_pair.preds").eqNullSafe(F.col("_pair.labels")).cast("bigint")
    return (
        df.select(F.posexplode(_pairs()).alias("pos", "_pair"))
        .groupBy("pos")
        .agg((F.sum(right * counted) / (F.sum(counted) + EPSILON)).alias("token_acc"))
    )


def eval_metrics(df: DataFrame, eos_id: int) -> DataFrame:
    """``seq_acc`` and every ``token_acc_i`` as ``(metric, value)`` rows from one scan.

    Each row gives one entry per position and one (position -1) for the whole sequence; the
    entries are added up before the shuffle.
    """
    whole = F.struct(
        F.lit(-1).alias("pos"),
        _row_correct(eos_id).cast("bigint").alias("right"),
        F.lit(1).cast("bigint").alias("counted"),
    )
    per_pos = F.transform(
        _pairs(),
        lambda p, i: F.struct(
            i.cast("int").alias("pos"),
            ((p["labels"] != eos_id) & p["preds"].eqNullSafe(p["labels"]))
            .cast("bigint")
            .alias("right"),
            (p["labels"] != eos_id).cast("bigint").alias("counted"),
        ),
    )
    sums = (
        df.select(F.inline(F.concat(F.array(whole), per_pos)))
        .groupBy("pos")
        .agg(F.sum("right").alias("right"), F.sum("counted").alias("counted"))
    )
    is_seq = F.col("pos") == -1
    metric = F.when(is_seq, "seq_acc").otherwise(F.concat(F.lit("token_acc_"), F.col("pos")))
    value = F.when(is_seq, F.col("right") / F.col("counted")).otherwise(
        F.col("right") / (F.col("counted") + EPSILON)
    )
    return sums.select(metric.alias("metric"), value.alias("value"))


def sequence_sizes(df: DataFrame) -> tuple[int, int]:
    """Rows of a logit table, and those of its longest sequence: one pass over ``seq``."""
    sizes = df.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.sum("n"), F.max("n")).first()
    return found[0] or 0, found[1] or 0


def shift_pairs(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Score position ``j`` against the label at ``j + 1``: the last position of each goes.

    Sequences of up to ``longest`` positions are windows of their own; where one is longer, labels are
    shifted by ranges of the keys, so that it meets in no single task.
    """
    return _shifted(df, sequence_sizes(df)[1] > longest, longest)


def _shifted(df: DataFrame, by_ranges: bool, longest: int) -> DataFrame:
    if by_ranges:
        shifted = following(df, "seq", "pos", ["label"], "_next", longest)
        return shifted.filter(F.col("_next").isNotNull()).withColumn("label", F.col("_next.label")).drop("_next")
    by_pos = Window.partitionBy("seq").orderBy("pos")
    return (
        df.withColumn("_next", F.lead("label").over(by_pos))
        .withColumn("_has", F.lead(F.lit(1)).over(by_pos))
        .filter(F.col("_has").isNotNull())
        .withColumn("label", F.col("_next"))
        .drop("_next", "_has")
    )


def shifted_predictions(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``seq, pos, pred, label, correct`` after the shift.

    The vectors are reduced to their arg max before the shift, so they are not shuffled.
    """
    return _predicted(df, sequence_sizes(df)[1] > longest, longest)


def _predicted(df: DataFrame, by_ranges: bool, longest: int) -> DataFrame:
    narrow = df.select("seq", "pos", argmax(F.col("v")).alias("pred"), "label")
    narrow = staged(narrow) if by_ranges else narrow  # ranges read their keys several times
    hit = F.col("pred").eqNullSafe(F.col("label")).cast("int")
    return _shifted(narrow, by_ranges, longest).withColumn("correct", hit)


def train_seq_acc(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Share of sequences right at every label other than -1, one ``(metric, value)`` row.

    A sequence of one position has nothing left to predict after the shift and counts as right.
    """
    narrow = df.select("seq", "pos", argmax(F.col("v")).alias("pred"), "label")
    if sequence_sizes(df)[1] > longest:
        told = following(staged(narrow), "seq", "pos", ["label"], "_f", longest)
        shifted = told.withColumn("_next", F.col("_f.label")).withColumn("_has", F.col("_f").isNotNull())
    else:
        by_pos = Window.partitionBy("seq").orderBy("pos")
        shifted = narrow.withColumn("_next", F.lead("label").over(by_pos)).withColumn(
            "_has", F.lead(F.lit(1)).over(by_pos).isNotNull()
        )
    hit = (F.col("_has") & F.col("pred").eqNullSafe(F.col("_next"))).cast("int")
    per_seq = shifted.groupBy("seq").agg(
        F.sum(hit).alias("_right"),
        F.sum((F.col("_has") & (F.col("_next") != IGNORE)).cast("int")).alias("_counted"),
    )
    right = (F.col("_right") == F.coalesce("_counted", F.lit(0))).cast("double")
    return per_seq.agg(F.avg(right).alias("value")).select(
        F.lit("train_seq_acc").alias("metric"), "value"
    )


def column_acc(df: DataFrame) -> DataFrame:
    """Mean of ``correct`` per position over all rows, without a mask: ``pos, column_acc``."""
    return shifted_predictions(df).groupBy("pos").agg(F.avg("correct").alias("column_acc"))


def kth_token_acc(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Accuracy of the k-th counted label of a sequence, wherever it stands: ``k, kth_acc``."""
    by_ranges = sequence_sizes(df)[1] > longest
    shifted = _predicted(df, by_ranges, longest)
    counted = (F.col("label") != IGNORE).cast("int")
    if by_ranges:
        numbered = running_total(staged(shifted), ["seq", "pos"], counted, ["seq"], "k", longest)
        numbered = numbered.withColumn("k", F.col("k") + counted)
    else:
        before = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        numbered = shifted.withColumn("k", F.sum(counted).over(before).cast("bigint"))
    return numbered.filter(F.col("label") != IGNORE).groupBy("k").agg(F.avg("correct").alias("kth_acc"))


def _among(keys: DataFrame, n: int, columns: Sequence[str]) -> Column:
    """Whether a row may be among ``keys``: one bit for each of 16 times their number, set or not.

    The bits are one array value, looked up where the row is. One row in 16 passes without being there.
    """
    words = max(1, n // 4)
    bits = lambda: F.pmod(F.xxhash64(*columns), F.lit(words * 64))
    one = F.lit(1).cast("bigint")
    place = F.shiftright(bits(), 6)
    shift = bits().bitwiseAND(F.lit(63)).cast("int")
    held = keys.select(place.alias("w"), F.expr("1L").alias("one"), shift.alias("s")).groupBy("w").agg(
        F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("s"))).alias("b")
    )
    every = keys.sparkSession.range(words).select(F.col("id").alias("w")).join(held, "w", "left")
    array = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))))["b"])
    word = F.get(array.scalar(), place.cast("int"))
    return F.call_function("shiftrightunsigned", word, shift).bitwiseAND(one) == 1


def masked_nll(
    df: DataFrame, in_place: bool = False, longest: int = LONGEST, filter_from: int = FILTER_FROM
) -> DataFrame:
    """Mean cross-entropy over labels other than -1, after the shift: ``n_tokens, loss``.

    The label needed at a position stands in the row behind it. A large table, of ``filter_from`` rows
    or more, has its labels shifted on their own; they then meet the vectors by key, and vectors of
    masked positions are filtered out by a bitmap of the keys wanted before anything is shuffled. The
    bitmap has ``FILTER_KEYS`` keys at most; of more, all vectors move, as in a small table. A table
    bucketed by ``seq`` needs no shuffle at all: say ``in_place``.
    """
    rows, widest = (0, 0) if in_place else sequence_sizes(df)
    if widest > longest or rows >= filter_from:
        wanted = staged(
            _shifted(df.select("seq", "pos", "label"), widest > longest, longest).filter(F.col("label") != IGNORE)
        )
        n, vectors = wanted.count(), df.select("seq", "pos", "v")
        if n <= FILTER_KEYS:
            vectors = vectors.filter(_among(wanted, n, ["seq", "pos"]))
        scored = vectors.join(wanted, ["seq", "pos"])
    else:
        scored = _shifted(df.select("seq", "pos", "v", "label"), False, longest).filter(F.col("label") != IGNORE)
    return scored.select(token_nll(F.col("v"), F.col("label")).alias("_nll")).agg(
        F.count("_nll").alias("n_tokens"), F.avg("_nll").alias("loss")
    )


def perplexity(df: DataFrame, in_place: bool = False) -> DataFrame:
    """``exp`` of the masked cross-entropy; infinite when that overflows."""
    return masked_nll(df, in_place).select("n_tokens", F.exp("loss").alias("perplexity"))


def union_batches(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack the results of several batches by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def metric_flush(
    df: DataFrame,
    split: str = "split",
    seq: str = "seq",
    key: str = "key",
    value: str = "value",
    is_flush: str = "is_flush",
    keep_open: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Mean per split and key between log events: ``split, flush_id, key, value``.

    A flush row reports the values since the previous flush of its split and stores none itself.
    Values after the last flush of a split are not reported yet; ``keep_open`` adds them.
    """
    slim = df.select(split, seq, key, value, is_flush)
    flush = F.col(is_flush).cast("int")
    numbered = running_total(slim, seq, flush, [split], "flush_id", rows_per_range)
    means = (
        numbered.filter(~F.col(is_flush))
        .groupBy(split, "flush_id", key)
        .agg(F.avg(value).alias(value))
    )
    if keep_open:
        return means
    flushes = slim.groupBy(split).agg(F.sum(flush).alias("_flushes"))
    return (
        means.join(flushes, split)
        .filter(F.col("flush_id") < F.col("_flushes"))
        .drop("_flushes")
    )
