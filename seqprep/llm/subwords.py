"""Quality classifier on supervised subword embeddings.

A document is the mean of the learnt vectors of its features: each word, its character n-grams of 3
to 5 code points (with a mark at both ends of the word), and each pair of words in a row, all hashed
to ``BUCKETS`` rows. A softmax of a linear map of that mean gives the classes. Vectors and map are
trained together by stochastic gradient descent in numpy, one document after the other.

Words are runs without white space, case and marks kept, since both tell of quality. A word that
stands twice in a row makes the pair "repeat", whatever it is.

Training sees ``SAMPLE`` labelled documents at most, picked by a hash of their doc_id and text. Their
features are counted by Spark; one task of this bounded size fits the model. As the map is linear, a
feature adds a fixed margin to the logits: scoring looks up one number a feature, over whole texts.

Defined cases: a null or empty text has no features, so its score is that of the bias; a doc_id with
several labels has the smallest; rows of a doc_id without a label are not learnt from; repeated rows
(doc_id and text) are learnt from once; labels other than 0 and 1 do not count; without labelled rows
of both classes there is a constant score, that of the only label (0.5 of none); a run of more than
``MOST`` characters without white space is several words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, only_cache, staged

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (3, 4, 5)
SAMPLE = 4000  # labelled documents that the model is fitted on, at most
EPOCHS, RATE = 5, 0.1
PIECE = 200_000  # characters taken at a time; a piece ends behind a word
MOST = 1_000_000  # characters of a word

SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _REPEAT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes ^ (hashes >> np.uint64(29))
    mixed *= _MIX
    return (mixed >> np.uint64(48)).astype(np.int32)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _MIX | np.uint64(1), np.uint64))


def _pieces(text: str) -> Iterator[str]:
    """A text cut behind words into pieces of a bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            spaces = [p for p in (text.find(c, end, at + MOST) for c in " \n\t\r") if p >= 0]
            end = min(spaces, default=at + MOST)
        yield text[at:end]
        at = end


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, repeated ones as often as they stand, piece by piece."""
    before = None  # the last word's hash of the piece before
    for piece in _pieces(text or ""):
        points = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        blank = (points <= 32) | (points == 160) | (points == 0x3000)
        points[blank] = 32
        inside = ~blank
        starts = np.flatnonzero(inside[1:] & blank[:-1]) + 1
        if not len(starts):
            continue
        # A word's hash is the sum of its code points, each times a power for its place in the word.
        word_no = np.cumsum(inside & np.concatenate([[True], blank[:-1]])) - 1
        letters = np.flatnonzero(inside)
        place = letters - starts[word_no[letters]]
        terms = (points[letters] + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
        words = np.add.reduceat(terms, np.searchsorted(letters, starts))
        words ^= words >> np.uint64(31)
        yield _bucket(words)
        chain = words if before is None else np.concatenate([before, words])
        pairs = chain[:-1] * _PAIR + chain[1:]
        pairs[chain[:-1] == chain[1:]] = _REPEAT
        yield _bucket(pairs)
        before = words[-1:]
        # n-grams may begin and end with the blank that marks the word's end, but not go across it.
        rolled = points + np.uint64(7)
        for n in range(2, GRAMS[-1] + 1):
            rolled = rolled[:-1] * _MIX + points[n - 1 :]
            if n in GRAMS:
                middle = np.cumsum(np.concatenate([[0], blank]))
                whole = middle[n - 1 : len(blank)] == middle[1 : len(blank) - n + 2]
                yield _bucket(rolled[whole] * np.uint64(2 * n + 1))


@dataclass(frozen=True)
class Model:
    margins: np.ndarray  # what each bucket adds to the logit of class 1, less that of class 0
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for found in features(text):
            total += float(self.margins[found].sum())
            n += len(found)
        logit = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 13
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, map and bias from ``(buckets, shares, label)`` of documents: distinct buckets and their
    share of the document's features.

    The rate falls to 0 by and by. A share is small where features are many, so the step of the vectors
    is taken times the number of distinct features: long and short documents then move theirs alike.
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)).tolist():
            buckets, shares, label = rows[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            known = vectors[buckets]
            hidden = shares @ known
            logits = out @ hidden + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[label] -= 1
            back = wrong @ out
            out -= lr * np.outer(wrong, hidden)
            bias -= lr * wrong
            vectors[buckets] = known - lr * np.outer(shares * np.float32(len(buckets)), back)
    return vectors, out, bias


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    only_cache("subwords")
    for batch in batches:
        for key, label, text in zip(batch.column("draw"), batch.column("label"), batch.column("text")):
            parts = list(features(text.as_py()))
            counts = np.bincount(np.concatenate(parts), minlength=1) if parts else np.zeros(1, np.int64)
            buckets = np.flatnonzero(counts)
            shares = (counts[buckets] / max(counts.sum(), 1)).astype("<f4")
            yield key.as_py(), label.as_py(), buckets.astype("<i4").tobytes(), shares.tobytes()


COUNTED = pa.schema(
    [("draw", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("shares", pa.binary())]
)


def train(
    df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, epochs: int = EPOCHS, rate: float = RATE,
) -> Model:
    """Fit the classifier on ``sample`` labelled documents at most; ``labels`` has doc_id and label."""
    told = (
        needed(labels, key=doc_id, label=label)
        .filter("key is not null and label in (0, 1)")
        .groupBy("key")
        .agg(F.min(F.col("label").cast("int")).alias("label"))
    )
    # Only keys are drawn, first of the labels, then of the documents that have them: a doc_id may
    # stand for many. So what is broadcast has ``sample`` rows, and only their texts move.
    few = staged(told.orderBy(F.xxhash64("key", F.lit(13)), "key").limit(sample))
    docs = needed(df, key=doc_id, text=text).withColumn("draw", F.xxhash64("key", "text", F.lit(17)))
    labelled = docs.join(F.broadcast(few), "key")
    drawn = staged(labelled.select("draw", "label").distinct().orderBy("draw", "label").limit(sample))
    picked = (
        docs.join(F.broadcast(drawn), "draw")
        .groupBy("draw", "label")
        .agg(F.min("text").alias("text"))
        .select("draw", "label", "text")
    )
    counted = staged(
        picked.mapInArrow(
            lambda batches: arrow_rows(COUNTED, _counted(batches)),
            "draw bigint, label int, buckets binary, shares binary",
        )
    )

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "label"])
        rows = [
            (np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4"), int(y))
            for b, s, y in zip(group["buckets"], group["shares"], group["label"])
        ]
        vectors, out, bias = fit(rows, epochs, rate)
        margins = (vectors @ (out[1] - out[0])).astype("<f4")
        return pd.DataFrame({"margins": [margins.tobytes()], "bias": [float(bias[1] - bias[0])]})

    shares = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        known = 1 if shares.get(1) else 0
        return Model(np.zeros(BUCKETS, np.float32), (60.0 if known else -60.0) if shares else 0.0)
    made = counted.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda rows: fitted(rows), "margins binary, bias double"
    ).first()
    return Model(np.frombuffer(made["margins"], "<f4"), made["bias"])


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: the probability of label 1. Only the text is looked at."""
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        only_cache("subwords")
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                yield key.as_py(), sent.value.score(text.as_py())

    return docs.mapInArrow(lambda batches: arrow_rows(SCORED, scored(batches)), "doc_id bigint, score double")
