"""Language identification by the nearest of several centroids per language.

A text becomes counts of its 1- to 3-byte n-grams (lower-cased UTF-8, everything in ASCII but
letters being a space), hashed to a fixed number of columns; log counts times inverse document
frequency, scaled to length 1, are its vector. Training clusters the vectors of each language into a
few centroids by cosine, one task a language, on a bounded sample of its labelled rows, for a bounded
number of languages; what the driver gathers is the model only: centroids of a fixed width per language.

A prediction is the language of the centroid with the largest cosine. It is rejected when its
distance (1 - cosine) is beyond the language's radius for texts of that length: a high quantile of the
distances of sampled texts that its centroids have not seen, and a small slack. A part of the sample is
kept out of clustering for this; of a language with few rows, each part in turn. Beginnings of these
texts give the radii of shorter lengths, the longest length known that of longer ones; a language of a
single row has the widest radius of the others. Texts shorter
than ``SHORT`` bytes say too little and are rejected only when they share nothing with any centroid.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without
training rows so is every text; ties go to the alphabetically first language; rows without a label
or an id are not learnt from; repeated rows are learnt from once, and count as often as they stand
where languages are ranked by rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, only_cache, pieces_of, sliced, staged

WIDTH = 4096  # columns that n-grams are hashed to
SAMPLE = 2000  # labelled rows of a language that the classifier is fitted on, at most
CENTROIDS = 4
LANGUAGES = 1000  # languages that are learnt, those with most rows: a model of 64 MB
SHORT = 64
FOLDS = 4  # one of them is kept out of clustering and gives the radii
FEW = 80  # rows of a language below which each fold is kept out in turn
QUANTILE, SLACK = 0.995, 0.05  # of the distances of texts kept out; what is added to it
UNKNOWN = "und"

PREDICTED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("rejected", pa.bool_()),
    ]
)
COUNTED = pa.schema(
    [
        ("lang", pa.string()),
        ("draw", pa.int64()),
        ("fold", pa.int32()),
        ("few", pa.bool_()),
        ("whole", pa.bool_()),
        ("bucket", pa.int32()),
        ("columns", pa.list_(pa.int32())),
        ("n", pa.list_(pa.int32())),
    ]
)
COUNTED_DDL = (
    "lang string, draw bigint, fold int, few boolean, whole boolean, bucket int, columns array<int>, n array<int>"
)
_BUCKETS = 40  # of lengths, by powers of two
_LETTER = re.compile("[A-Za-z]")
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def counts(text: str) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts of a whole text, and its number of bytes."""
    data = text.lower().encode().translate(_SPACED)
    one = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    two = one[:-1] * np.uint32(257) + one[1:]
    three = two[:-1] * np.uint32(257) + one[2:]
    grams = np.concatenate([one, two + np.uint32(1 << 20), three + np.uint32(1 << 28)])
    columns = (grams * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(columns, minlength=WIDTH), len(data)


def _sparse(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns = np.flatnonzero(found)
    return columns, found[columns]


def _unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(rows) * idf
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    return (weighted / np.maximum(norms, 1e-12)).astype(np.float32)


def _bucket(n_bytes: int) -> int:
    return min(int(n_bytes).bit_length(), _BUCKETS - 1)


def _beginnings(text: str) -> Iterator[tuple[str, int]]:
    """Beginnings of a text of 64, 128 ... bytes, each the shortest of its length bucket."""
    data = text.encode()
    n = SHORT
    while 2 * n <= len(data):
        yield data[:n].decode(errors="ignore"), _bucket(n)
        n *= 2


def radii(buckets: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The radius of each length from distances of texts kept out; lengths without any take that of
    the next shorter length, or of the shortest."""
    found = np.zeros(_BUCKETS)
    known = sorted(set(buckets.tolist()))
    for b in range(_BUCKETS):
        own = max((k for k in known if k <= b), default=known[0])
        found[b] = np.quantile(far[buckets == own], QUANTILE) + SLACK
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # language of each centroid
    radius: np.ndarray  # languages x length buckets

    def predict(self, rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (its place), cosine and rejection of count vectors."""
        near = _unit(rows, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(best)), best].astype(float), 0.0, 1.0)
        owner = self.owner[best]
        buckets = np.array([_bucket(n) for n in sizes])
        far = 1 - score > np.where(np.array(sizes) < SHORT, 1.0, self.radius[owner, buckets])
        return owner, score, far | (score <= 0)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, begun with far-off vectors."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack(
            [vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))]
        )
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def train(
    df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
    sample: int = SAMPLE, k: int = CENTROIDS, most: int = LANGUAGES,
) -> Model | None:
    """Fit the classifier on ``sample`` rows at most of each of the ``most`` languages with most rows.

    Rows are picked by a hash of key and text. They are thinned before they are ranked, equal ones
    before they are moved, so no language meets whole in a task.
    """
    rows = needed(df, key=key, lang=lang, text=text).filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    draw = F.xxhash64("key", "text", F.lit(7))
    thin = F.pmod(draw, F.lit(1 << 20)) < F.lit(1.5 * sample * (1 << 20)) / F.col("n")
    distinct = (
        rows.join(F.broadcast(staged(sizes)), "lang")
        .filter(thin | (F.col("n") <= sample))
        .groupBy("lang", draw.alias("draw"))
        .agg(F.min("text").alias("text"), F.first("n").alias("n"))
    )
    picked = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    few = F.least("n", F.lit(sample)) < FEW
    picked = picked.filter(F.col("nth") <= sample).select(
        "lang", "text", "draw", F.pmod("nth", F.lit(FOLDS)).alias("fold"), few.alias("few")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in (part for whole in batches for part in sliced(whole, 64)):
            for lang, text, draw, fold, few in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
                if not has_letter(text):
                    continue
                found, n = counts(text)
                yield lang, draw, fold, few, True, _bucket(n), *_sparse(found)
                for part, bucket in _beginnings(text) if few or not fold else ():
                    if has_letter(part):
                        yield lang, draw, fold, few, False, bucket, *_sparse(counts(part)[0])

    counted = staged(picked.mapInArrow(lambda batches: arrow_rows(COUNTED, count(batches)), COUNTED_DDL))
    whole = counted.filter("whole")
    total = whole.count()
    if not total:
        return None
    within = np.zeros(WIDTH)
    for row in whole.select(F.explode("columns").alias("c")).groupBy("c").count().collect():  # WIDTH rows at most
        within[row["c"]] = row["count"]
    idf = np.log((1 + total) / (1 + within)) + 1

    def dense(group: pd.DataFrame) -> np.ndarray:
        made = np.zeros((len(group), WIDTH), np.float32)
        for row, columns, n in zip(made, group["columns"], group["n"]):
            row[columns] = n
        return made

    def distances(group: pd.DataFrame, centroids: np.ndarray) -> np.ndarray:
        parts = (group.iloc[at : at + 256] for at in range(0, len(group), 256))
        found = [1 - (_unit(dense(part), idf) @ centroids.T).max(axis=1) for part in parts]
        return np.concatenate(found) if found else np.zeros(0)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "bucket"])  # the same order under any partitioning
        fold = group["fold"].to_numpy()
        few = bool(group["few"].iloc[0]) or not (fold == 0).any()
        held = group["whole"].to_numpy(bool)
        own = fold[held]
        vectors = np.concatenate(
            [_unit(dense(part), idf) for part in np.array_split(group[held], pieces_of(held.sum(), 256))]
        )
        buckets, far = [], []
        for out in range(FOLDS) if few else (0,):
            learnt = vectors[own != out]
            found = cluster(learnt if len(learnt) else vectors, k)
            part = group[fold == out]
            buckets.append(part["bucket"].to_numpy())
            far.append(distances(part, found))
        if few:
            found = cluster(vectors, k)
        # A single row tells nothing of the distances of others.
        radius = np.full(_BUCKETS, np.nan)
        if len(vectors) > 1:
            radius = radii(np.concatenate(buckets), np.concatenate(far))
        return pd.DataFrame(
            {
                "lang": group["lang"].iloc[0],
                "centroid": [c.astype("<f4").tobytes() for c in found],
                "radius": [radius.astype("<f8").tobytes()] * len(found),
            }
        )

    fitted = counted.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, radius binary")
    rows = sorted((r["lang"], r["centroid"], r["radius"]) for r in fitted.collect())
    languages = sorted({r[0] for r in rows})
    reach = {r[0]: np.frombuffer(r[2], "<f8") for r in rows}
    radius = np.stack([reach[name] for name in languages])
    widest = np.fmax.reduce(radius, axis=0)
    radius = np.where(np.isnan(radius), np.where(np.isnan(widest), 1.0, widest), radius)
    return Model(
        languages,
        idf,
        np.stack([np.frombuffer(r[1], "<f4") for r in rows]),
        np.array([languages.index(r[0]) for r in rows]),
        radius,
    )


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[tuple]:
    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for at in range(0, len(keys), 256):
            part = [t.as_py() for t in texts[at : at + 256]]
            told = [i for i, t in enumerate(part) if model is not None and has_letter(t)]
            answers: list[tuple] = [(UNKNOWN, 0.0, True)] * len(part)
            if told:
                made = [counts(part[i]) for i in told]
                found = model.predict(np.stack([c for c, _ in made]), [n for _, n in made])
                for i, owner, score, far in zip(told, *[f.tolist() for f in found]):
                    answers[i] = (model.languages[owner], score, far)
            for key, answer in zip(keys[at : at + 256], answers):
                yield key, *answer


def accepted(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not rejected, with all their columns. Only the text is sent to
    Python, and only a truth value comes back."""

    def keep(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only_cache("langid")
        for texts in columns:
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
            yield pa.array([not row[3] for row in _predicted(iter([batch]), sent.value)], pa.bool_())

    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = F.arrow_udf(keep, "boolean")
    return df.filter(kept(F.col(f"`{text}`")))


def predict(df: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every whole text. Only the text is looked at."""
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(
        lambda batches: arrow_rows(PREDICTED, _predicted(batches, sent.value)),
        "doc_id bigint, lang_pred string, score double, rejected boolean",
    )
