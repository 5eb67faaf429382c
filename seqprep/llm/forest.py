"""Nearest neighbours by inner product from a hash-prefix forest.

A tree of the forest gives each vector a 32-bit hash string (signs of random projections) and keeps
the strings as one sorted array: vectors that share a prefix are a run of it, so no tree nodes are
needed. A query goes down every tree to its longest matching prefix, then up all trees together,
one bit at a time, until the runs hold enough candidates; their inner products decide.

Larger norms win inner products, so vectors get one more component that lifts them all to the
largest norm of their block (queries get 0): then the cosine ranks as the inner product does.

The index is cut into blocks of vectors by a hash of their ids; every block has its own forest and
is written as one row of a table. Queries are sent to every block, stream past it a thousand at a
time, and the best of all blocks are merged. Candidates are a share of the block, because the 20
nearest of vectors without clusters are spread over many prefixes: see the README for recall.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id; of rows with the same id the one
with the smallest vector counts; a query is
no candidate of its own; ties go to the smaller id; fewer candidates than asked give fewer rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, pieces_of, staged

TREES, LENGTH = 128, 32
BLOCK = 8192
SHARE = 0.45  # candidates of a block, counted once a tree, before a query stops going up
LEAST = 2000  # the same for small blocks
QUERIES = 1024  # queries searched together

INDEX_DDL = "block bigint, ids binary, vectors binary, keys binary, places binary"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def planes(dim: int, seed: int = 5) -> np.ndarray:
    """Projections of all trees, one column a bit."""
    return np.random.default_rng(seed).standard_normal((dim, TREES * LENGTH)).astype(np.float32)


def hash_strings(rows: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """One 32-bit string per vector and tree; the first bit is the highest."""
    bits = rows.astype(np.float32) @ projections > 0
    octets = np.packbits(bits.reshape(len(rows), TREES, LENGTH), axis=2)
    return octets.reshape(len(rows), TREES, 4).view(">u4")[:, :, 0].astype(np.uint32)


def build(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings of every tree, and which vector each belongs to."""
    norms = np.linalg.norm(vectors, axis=1)
    lift = np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0))
    strings = hash_strings(np.column_stack([vectors, lift]), planes(vectors.shape[1] + 1))
    places = np.argsort(strings, axis=0, kind="stable").astype(np.int32)
    return np.take_along_axis(strings, places, axis=0).T.copy(), places.T.copy()


def _runs(keys: np.ndarray, asked: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs that share ``depth`` bits with each query, per tree."""
    lo, hi = np.empty((TREES, len(asked)), np.int64), np.empty((TREES, len(asked)), np.int64)
    rest = (LENGTH - depth).astype(np.uint64)
    for t in range(TREES):
        first = (asked[:, t].astype(np.uint64) >> rest) << rest
        lo[t] = np.searchsorted(keys[t], first)
        hi[t] = np.searchsorted(keys[t], first + (np.uint64(1) << rest))
    return lo, hi


def ascend(keys: np.ndarray, asked: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs at the longest prefix length at which all trees together hold ``wanted`` entries.

    Going up one bit can only add entries, so the length is found by halving.
    """
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), LENGTH, np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        lo, hi = _runs(keys, asked, middle)
        enough = (hi - lo).sum(axis=0) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return _runs(keys, asked, low)


class _Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(self.ids), -1)
        self.single = self.vectors.astype(np.float32)
        self.keys = np.frombuffer(row["keys"], "<u4").astype(np.uint64).reshape(TREES, -1)
        self.places = np.frombuffer(row["places"], "<i4").reshape(TREES, -1)
        self.largest = float(np.linalg.norm(self.vectors, axis=1).max())

    def search(self, ids: list[int], queries: np.ndarray, k: int) -> Iterator[tuple]:
        """The ``k`` nearest candidates of each query, by exact double products."""
        n = len(self.ids)
        wanted = min(max(int(SHARE * n), LEAST), TREES * n)
        plain = np.column_stack([queries, np.zeros(len(queries))])
        lo, hi = ascend(self.keys, hash_strings(plain, planes(plain.shape[1])), wanted)
        for q, key in enumerate(ids):
            held = np.zeros(n, bool)
            for t in range(TREES):
                held[self.places[t, lo[t, q] : hi[t, q]]] = True
            found = np.flatnonzero(held & (self.ids != key))
            if len(found) > k:  # single precision first, with room for its error
                rough = self.single[found] @ queries[q].astype(np.float32)
                room = 1e-5 * self.largest * float(np.linalg.norm(queries[q]))
                found = found[rough >= np.partition(rough, -k)[-k] - room]
            scores = (self.vectors[found] * queries[q]).sum(axis=1)
            for i in np.lexsort((self.ids[found], -scores))[:k].tolist():
                yield key, int(self.ids[found[i]]), float(scores[i])


def valid(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Usable vectors: ``vec_id, vector`` in double precision, all of the most common length, one for an id."""
    rows = needed(df, vec_id=vec_id, vector=vector).select(
        F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>")
    ).filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (common["n"] if common else 0))
    # Of rows with the same id the smallest vector counts, whatever their order.
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def write_index(df: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write the blocks of ``vectors_of`` rows, each with its forest, to ``path``."""
    n_blocks = pieces_of(df.count(), block)

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
        ids, vectors = rows["vec_id"].to_numpy("<i8"), np.stack(rows["vector"]).astype("<f8")
        keys, places = build(ids, vectors)
        return pd.DataFrame(
            {
                "block": [key[0]], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()],
                "keys": [keys.astype("<u4").tobytes()], "places": [places.astype("<i4").tobytes()],
            }
        )

    dealt = df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(n_blocks)))
    dealt.groupBy("block").applyInPandas(make, INDEX_DDL).write.parquet(path)


def _streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """A block's row comes before the queries sent to it."""
    block: _Block | None = None
    ids: list[int] = []
    rows: list[list[float]] = []
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            if batch.column("vec_id")[i].as_py() is None:
                if ids:
                    yield from block.search(ids, np.array(rows), k)
                    ids, rows = [], []
                block = _Block({n: batch.column(n)[i].as_buffer() for n in names if n in _PARTS})
                continue
            ids.append(batch.column("vec_id")[i].as_py())
            rows.append(batch.column("vector")[i].values.to_numpy())
            if len(ids) == QUERIES:
                yield from block.search(ids, np.array(rows), k)
                ids, rows = [], []
    if ids:
        yield from block.search(ids, np.array(rows), k)


_PARTS = ("ids", "vectors", "keys", "places")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found; ``queries`` as ``vectors_of``."""
    index = spark.read.parquet(path)
    n_blocks = index.count()
    if not n_blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    every = F.explode(F.array(*[F.lit(r["block"]) for r in index.select("block").collect()]))
    asked = queries.dropDuplicates(["vec_id"]).withColumn("block", every)
    both = index.unionByName(asked, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("vec_id").asc_nulls_first())
    found = dealt.mapInArrow(
        lambda batches: arrow_rows(FOUND, _streamed(batches, k)),
        "query_id bigint, vec_id bigint, score double",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
