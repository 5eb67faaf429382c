"""Cross-entropy difference of matched target and background n-gram models.

Both models are character n-gram models of the same order, with the same smoothing and one shared
vocabulary: every code point (lower-cased), without a cap, and a mark that stands before a text. The
target model is counted on the documents marked as target, the background model on all others; every
document and every n-gram counts, in tables that Spark writes and that grow with the corpus.

A character's probability is interpolated from order n down to 0 (Witten-Bell): the share an order
leaves to the next is types / (types + occurrences) of its context. A document's score is the mean
over its characters of the target's loss less the background's (in nats): the lower, the closer to
the target. The most frequent n-grams, ``HOT`` at most, are broadcast with their losses; a document's
other n-grams, distinct ones with how often they stand, are joined with the tables by a shuffle, in
which no n-gram is frequent. N-grams that the corpus lacks get their loss from the lower orders.

Defined cases: a null or empty text has no characters and null scores; before a text stand ``ORDER``
- 1 marks; without target or without background documents the missing model is uniform; repeated rows
count as often as they stand; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, small, staged

SYMBOLS, ORDER = 0x110000 + 1, 4  # all code points, and the mark before a text
BITS = 21  # of a symbol
FLUSH = 4_000_000  # characters counted before sums are handed on
HOT = 1_000_000  # n-grams whose losses are broadcast: 48 MB
NUMBERED = 65_535  # characters that fit 16 bits, so that four make one number
BROADCAST_ROWS = 2_000_000  # ids of target documents, 16 MB
SENT_ROWS = 200_000  # rows of a count table that is joined by broadcast
UNIT = 1e9  # losses of joined n-grams are added up as whole numbers, in any order alike

COUNTED = pa.schema(
    [("ctx", pa.int64()), ("last", pa.int32()), ("target", pa.int64()), ("background", pa.int64())]
)
SCORED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("target", pa.float64()),
        ("background", pa.float64()),
        ("ctx", pa.list_(pa.int64())),
        ("last", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int64())),
    ]
)
SCORED_DDL = (
    "row bigint, doc_id bigint, n_chars bigint, target double, background double, "
    "ctx array<bigint>, last array<int>, times array<bigint>"
)


def symbols(text: str) -> np.ndarray:
    """The marks and then the characters of a text: code points from 1, the mark is 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), points + np.uint32(1)])


def _packed(numbers: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each place from the ``ORDER``-th on, of numbers of 16 bits."""
    n = len(numbers) - ORDER + 1
    total = np.zeros(n, np.uint64)
    for i in range(ORDER):
        total = (total << np.uint64(16)) | numbers[i : i + n].astype(np.uint64)
    return total


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Context (a number in base ``2 ** BITS``) and last symbol of n-grams."""
    ctx = np.zeros(len(parts[0]), np.int64)
    for part in parts[:-1]:
        ctx = (ctx << BITS) | part.astype(np.int64)
    return ctx, parts[-1].astype(np.int32)


def tally(found: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Context, last symbol and number of the n-grams of ``found`` whose ends are ``wanted``.

    Symbols are numbered by those that are there. With more of them than 16 bits tell apart, parts of
    fewer places are counted one by one, and an n-gram may come once for each.
    """
    if len(found) < 100_000:
        used, own = np.unique(found, return_inverse=True)
    else:
        used = np.flatnonzero(np.bincount(found, minlength=SYMBOLS))
        place = np.zeros(SYMBOLS, np.uint32)
        place[used] = np.arange(len(used))
        own = place[found]
    if len(used) > NUMBERED + 1:
        step = NUMBERED - ORDER
        for at in range(0, len(wanted), step):
            yield from tally(found[at : at + step + ORDER - 1], wanted[at : at + step])
        return
    grams, times = np.unique(_packed(own)[wanted], return_counts=True)
    parts = [used[(grams >> np.uint64(16 * i)) & np.uint64(0xFFFF)] for i in range(ORDER - 1, -1, -1)]
    yield *_joined(parts), times


@dataclass(frozen=True)
class Models:
    """Per order (from 1) the n-grams ``ctx, last, n, p_target, p_background`` and what their contexts
    hold: ``ctx`` and for both models ``types_*`` and ``all_*``, types and occurrences together."""

    grams: list[DataFrame]
    contexts: list[DataFrame]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[list, list] = ([], [])
    sizes = [0, 0]

    def add(kind: int) -> Iterator[pa.RecordBatch]:
        if not held[kind]:
            return
        found = np.concatenate(held[kind])
        held[kind].clear()
        sizes[kind] = 0
        for ctx, last, times in tally(found, found[ORDER - 1 :] > 0):
            for at in range(0, len(ctx), 50_000):
                part = slice(at, at + 50_000)
                counts = [np.zeros(len(ctx[part]), np.int64), times[part].astype(np.int64)]
                columns = [ctx[part], last[part], counts[1 - kind], counts[kind]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=COUNTED)

    for batch in batches:
        for text, target in zip(batch.column("text"), batch.column("target").to_pylist()):
            if text.is_valid:
                kind = 0 if target else 1
                held[kind].append(symbols(text.as_py()))
                sizes[kind] += len(held[kind][-1])
                if sizes[kind] >= FLUSH:
                    yield from add(kind)
    for kind in (0, 1):
        yield from add(kind)


def _suffix(order: int) -> Column:
    """The context of an n-gram's last ``order`` symbols."""
    return F.col("ctx").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1).cast("bigint"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, SENT_ROWS) else df


def _mixed(kind: str, own: Column, lower: Column) -> Column:
    """Own share and what the context leaves to the lower order; a context not seen leaves all."""
    total = F.col(f"all_{kind}")
    return F.when(total > 0, own / total + F.col(f"types_{kind}") / total * lower).otherwise(lower)


def train(docs: DataFrame) -> Models:
    """Count both models over all of ``docs`` (``text, target``)."""
    kinds = ("target", "background")
    sums = [F.sum(k).alias(k) for k in kinds]
    counted = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(
        _counted, "ctx bigint, last int, target bigint, background bigint"
    )
    counts = {ORDER: staged(counted.groupBy("ctx", "last").agg(*sums))}
    for k in range(ORDER - 1, 0, -1):
        shorter = counts[k + 1].withColumn("ctx", _suffix(k))
        counts[k] = staged(shorter.groupBy("ctx", "last").agg(*sums))
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        held = [
            x for kind in kinds for x in (
                F.count(F.when(F.col(kind) > 0, 1)).alias(f"types_{kind}"),
                (F.count(F.when(F.col(kind) > 0, 1)) + F.sum(kind)).alias(f"all_{kind}"),
            )
        ]
        contexts.append(staged(counts[k].groupBy("ctx").agg(*held)))
        own = counts[k].join(_sent(contexts[-1]), "ctx")
        if k == 1:
            lower = [F.lit(1.0 / SYMBOLS)] * 2
        else:
            below = grams[-1].select(
                F.col("ctx").alias("_ctx"), "last", *[F.col(f"p_{x}").alias(f"q_{x}") for x in kinds]
            )
            own = own.withColumn("_ctx", _suffix(k - 1)).join(_sent(below), ["_ctx", "last"])
            lower = [F.col(f"q_{x}") for x in kinds]
        made = [_mixed(x, F.col(x), q).alias(f"p_{x}") for x, q in zip(kinds, lower)]
        grams.append(staged(own.select("ctx", "last", (F.col("target") + F.col("background")).alias("n"), *made)))
    return Models(grams, contexts)


def unseen(asked: DataFrame, models: Models) -> DataFrame:
    """``ctx, last, p_target, p_background`` of n-grams (``ctx, last``) that the corpus may lack."""
    kinds = ("target", "background")
    found = asked.withColumns({f"q_{x}": F.lit(1.0 / SYMBOLS) for x in kinds})
    for k in range(1, ORDER + 1):
        known = models.grams[k - 1].select(F.col("ctx").alias("_ctx"), "last", *[f"p_{x}" for x in kinds])
        context = models.contexts[k - 1].withColumnRenamed("ctx", "_ctx")
        found = found.withColumn("_ctx", _suffix(k)).join(_sent(known), ["_ctx", "last"], "left").join(
            _sent(context), "_ctx", "left"
        )
        rest = [F.coalesce(f"p_{x}", _mixed(x, F.lit(0), F.col(f"q_{x}"))).alias(f"q_{x}") for x in kinds]
        found = found.select("ctx", "last", *rest)
    return found.select("ctx", "last", *[F.col(f"q_{x}").alias(f"p_{x}") for x in kinds])


@dataclass(frozen=True)
class Hot:
    """Losses of the frequent n-grams in a hash table with linear probing."""

    number: np.ndarray  # of each symbol, from 1; 0 is none
    keys: np.ndarray  # n-gram in each slot; 0 is none
    target: np.ndarray
    background: np.ndarray

    def _home(self, grams: np.ndarray) -> np.ndarray:
        shift = np.uint64(65 - len(self.keys).bit_length())
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def slots(self, grams: np.ndarray) -> np.ndarray:
        """The slot of each n-gram, -1 for those that are not here."""
        at = self._home(grams)
        held = self.keys[at]
        found = np.where(held == grams, at, -1)
        left = np.flatnonzero((held != grams) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            held = self.keys[at[left]]
            same = held == grams[left]
            found[left[same]] = at[left[same]]
            left = left[~same & (held != 0)]
        found[grams == 0] = -1  # nothing numbered, and the key of an empty slot
        return found

    def fill(self, grams: np.ndarray, target: np.ndarray, background: np.ndarray) -> None:
        left, at = np.arange(len(grams)), self._home(grams)
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = grams[left[free]]
            put = self.keys[at[left]] == grams[left]
            self.target[at[left[put]]] = target[left[put]]
            self.background[at[left[put]]] = background[left[put]]
            left = left[~put]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


def hot_of(models: Models) -> Hot:
    """The most frequent n-grams, ``HOT`` at most, by steps of their number; of ``NUMBERED`` characters
    at most."""
    grams = models.grams[-1].withColumn("level", F.floor(F.log2("n") * 16))
    levels = sorted(grams.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    sums = np.cumsum([r["n"] for r in levels])
    taken = [r["level"] for r in levels[: int(np.searchsorted(sums, HOT, "right"))]]
    picked = grams.filter(F.col("level") >= F.lit(min(taken))) if taken else grams.limit(0)
    rows = picked.select("ctx", "last", "p_target", "p_background").toArrow()
    ctx, last = (rows.column(x).to_numpy().astype(np.int64) for x in ("ctx", "last"))
    parts = [(ctx >> (BITS * i)) & ((1 << BITS) - 1) for i in range(ORDER - 2, -1, -1)] + [last]
    uses = np.bincount(np.concatenate(parts), minlength=SYMBOLS)
    kept = np.argsort(-uses, kind="stable")[: min(NUMBERED, int((uses > 0).sum()))]
    number = np.zeros(SYMBOLS, np.uint16)
    number[kept] = np.arange(1, len(kept) + 1)
    numbers = np.stack([number[x] for x in parts])
    whole = (numbers > 0).all(axis=0)
    keys = np.zeros(len(ctx), np.uint64)
    for x in numbers:
        keys = (keys << np.uint64(16)) | x.astype(np.uint64)
    slots = 1 << max(4, (2 * len(keys)).bit_length())
    found = Hot(number, np.zeros(slots, np.uint64), np.zeros(slots), np.zeros(slots))
    found.fill(keys[whole], *[-np.log(rows.column(f"p_{x}").to_numpy()[whole]) for x in ("target", "background")])
    return found


def _scored(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[tuple]:
    """Sums of the losses of frequent n-grams, and the other n-grams with how often they stand."""
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            row, text = row + 1, text.as_py()
            if not text:
                yield row, key, 0, None, None, None, None, None
                continue
            found = symbols(text)
            slots = hot.slots(_packed(hot.number[found]))
            here = slots >= 0
            sums = [float(x[slots[here]].sum()) for x in (hot.target, hot.background)]
            rest: list = [None] * 3
            if not here.all():
                rest = [np.concatenate(x).tolist() for x in zip(*tally(found, ~here))]
            yield row, key, len(slots), *sums, *rest


def with_target(
    df: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, text, target``: whether a document's id is among those of ``targets``."""
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ids = needed(targets, _id=doc_id).select(F.col("_id").cast("bigint")).filter("_id is not null").distinct()
    ids = F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids
    return docs.join(ids, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "text", F.col("_id").isNotNull().alias("target")
    )


def score(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, n_chars, loss_target, loss_background, score`` of every whole text."""
    kinds = ("target", "background")
    sent = docs.sparkSession.sparkContext.broadcast(hot_of(models))
    scored = staged(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: arrow_rows(SCORED, _scored(batches, sent.value), most_bytes=1 << 20), SCORED_DDL
        )
    )
    rest = scored.filter("ctx is not null").select(
        "row", F.explode(F.arrays_zip("ctx", "last", "times")).alias("c")
    ).select("row", "c.*")
    told = scored.withColumns({f"rest_{x}": F.lit(0).cast("bigint") for x in kinds})
    if not small(rest, 0):
        known = models.grams[-1].select("ctx", "last", *[f"p_{x}" for x in kinds])
        missing = staged(rest.select("ctx", "last").distinct().join(known, ["ctx", "last"], "left_anti"))
        if not small(missing, 0):
            known = known.unionByName(unseen(missing, models))
        losses = [
            F.sum(F.round(-F.log(f"p_{x}") * UNIT).cast("bigint") * F.col("times")).alias(f"rest_{x}") for x in kinds
        ]
        told = scored.join(rest.join(known, ["ctx", "last"]).groupBy("row").agg(*losses), "row", "left")
    means = [
        ((F.col(x) + F.coalesce(f"rest_{x}", F.lit(0)) / UNIT) / F.col("n_chars")).alias(f"loss_{x}") for x in kinds
    ]
    return told.select(
        "doc_id", "n_chars", *[F.when(F.col("n_chars") > 0, m).alias(f"loss_{x}") for x, m in zip(kinds, means)]
    ).withColumn("score", F.col("loss_target") - F.col("loss_background"))
