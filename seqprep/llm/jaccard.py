"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Each text becomes the set of its five-word shingles (64-bit hashes). Documents with equal sets
   are copies: one class, whose set is signed by 160 MinHash values of 8 bits.
2. Classes that agree in one of 32 bands of 5 values are candidates. A pair at the threshold of 0.8
   misses all bands with probability 3e-6. Of buckets with the same members one is kept.
3. A bucket of any size is cut into blocks of classes; pairs of blocks are compared by different
   tasks, and a pair only in the first band that it shares. Values are compared 32 at a time. With m
   matches among n and a flat prior, the similarity reaches the threshold with the probability that
   a Binomial(n + 1, threshold) is at most m; below the tolerance the pair goes (BayesLSH).
4. The shingle sets of what is left are compared exactly.
5. Tasks give, per class, its number of links and the local root, never pairs. Components of these
   are the classes of near duplicates.

Defined cases: a text without words (null, empty, marks only) links to nothing; one of fewer than
five words is one shingle of them all; repeated rows are copies; rows without a doc_id are compared
like others, and a class has no id only if none of its rows has; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, cached, needed, only_cache, small, staged, unused
from seqprep.llm.components import components
from seqprep.llm.positions import split_words

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 5
STEP = 32  # MinHash values compared at a time
BLOCK = 1024  # classes of a block: a task holds two blocks
BROADCAST_ROWS = 500_000  # ids and text hashes of documents, 8 MB
DENSE = 8_000_000  # cells of a membership matrix: its columns are taken in such parts
_KEPT_WORDS, _LONGEST = 150_000, 64  # words whose hashes are kept, and bytes of such a word
_MIX = np.uint64(0x9E3779B97F4A7C15)

SIGNED = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("d", pa.binary()), ("sig", pa.binary())])
SETS = pa.schema([("d", pa.binary()), ("shingles", pa.binary())])
PAIRED = pa.schema(
    [("g", pa.binary()), ("place", pa.int32()), ("d", pa.binary()), ("others", pa.binary())]
)
LINKED = pa.schema([("d", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) >> 1
        if len(word) <= _LONGEST:
            self[word] = value
        return value


_HASHES = _Hashes()
cached("jaccard", _HASHES.clear)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted set of a text's ``n``-word shingles, as 64-bit hashes."""
    found = split_words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(_HASHES) > _KEPT_WORDS:
        _HASHES.clear()
    words = np.fromiter(map(_HASHES.__getitem__, found), np.int64, len(found)).astype(np.uint64)
    n = min(n, len(words))
    rolled = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        rolled = (rolled * _MIX) ^ words[i : len(words) - n + 1 + i]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled * _MIX)


def _family(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return a[:, None], draw.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


_A, _B = _family(BANDS * ROWS)


def signature(found: np.ndarray) -> bytes:
    """8-bit MinHash values of a set, a few thousand members at a time."""
    small_ids = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small_ids), 2048):
        np.minimum(least, (_A * small_ids[at : at + 2048] + _B).min(axis=1), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def fewest_matches(threshold: float, tolerance: float, total: int = BANDS * ROWS) -> list[int]:
    """Per number of compared values (every ``STEP``), the fewest matches that keep a pair.

    Values of 8 bits also agree by chance, once in 256.
    """
    p = threshold + (1 - threshold) / 256
    kept = []
    for n in range(STEP, total + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        kept.append(m)
    return kept


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    only_cache("jaccard")
    for batch in batches:
        keys, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "t"))
        for key, t, text in zip(keys, hashes, batch.column("text")):
            found = shingles(text.as_py(), n)
            yield (key, t, _digest(found), signature(found)) if len(found) else (key, t, None, None)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    only_cache("jaccard")
    for batch in batches:
        for text in batch.column("text"):
            found = shingles(text.as_py(), n)
            yield _digest(found), found.tobytes()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with the same first column, which come one after the other."""
    held: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for row in zip(*[c.to_pylist() for c in part.columns]):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _pairs_of(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the rows to compare each row with: block 0 and 1 of a pair, or within one block.

    ``rows`` are sorted by block; the last column tells it. The group's name ends with both blocks.
    """
    name, n = rows[0][0], len(rows)
    if name[-8:-4] == name[-4:]:
        for i in range(n - 1):
            yield i, np.arange(i + 1, n)
    else:
        second = next((i for i, r in enumerate(rows) if r[-1]), n)
        for i in range(second if second < n else 0):
            yield i, np.arange(second, n)


def _prune(batches: Iterator[pa.RecordBatch], keep: list[int]) -> Iterator[tuple]:
    """Candidate pairs that outlive the comparison, as lists of places per class of a group."""
    for rows in _groups(batches):
        band = rows[0][0][ROWS]
        sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        cut = sigs.reshape(len(rows), BANDS, ROWS)
        others: dict[int, np.ndarray] = {}
        for i, j in _pairs_of(rows):
            if band:  # a pair belongs to the first band it shares
                earlier = (cut[j, :band] == cut[i, :band]).all(axis=2).any(axis=1)
                j = j[~earlier]
            matches = np.zeros(len(j), np.int64)
            for k, least in enumerate(keep):
                part = slice(k * STEP, (k + 1) * STEP)
                matches += (sigs[j, part] == sigs[i, part]).sum(axis=1)
                alive = matches >= least
                j, matches = j[alive], matches[alive]
                if not len(j):
                    break
            if len(j):
                others[i] = j
        if others:
            used = np.unique(np.concatenate([np.array(list(others)), *others.values()]))
            for i in used.tolist():
                yield rows[0][0], i, rows[i][1], others.get(i, np.empty(0)).astype("<i4").tobytes()


def _common(sets: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> Iterator[np.ndarray]:
    """Sizes of the intersections of each row of ``pairs``."""
    n = len(sets)
    if n <= 8 or 16 * sum(len(j) for _, j in pairs) <= n * n:
        for i, j in pairs:
            yield np.array([len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for k in j.tolist()])
        return
    # Many pairs: count by matrix products, over the shingles that several sets have.
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.cumsum(held > 1) - 1
    keep = held[column] > 1
    row, column = row[keep], shared[column[keep]]
    n_shared = int(shared[-1]) + 1
    step = max(1, min(n_shared, DENSE // n))
    common = np.zeros((n, n), np.int64)
    for at in range(0, n_shared, step):
        part = (column >= at) & (column < at + step)
        members = np.zeros((n, step), np.float32)
        members[row[part], column[part] - at] = 1
        common += (members @ members.T).round().astype(np.int64)
    for i, j in pairs:
        yield common[i, j]


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple]:
    """Number of links (copies counted) and local root of each class of a group that has links."""
    for rows in _groups(batches):
        at = {r[1]: k for k, r in enumerate(rows)}
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        copies = np.array([r[5] for r in rows])
        parent = list(range(len(rows)))
        links = np.zeros(len(rows), np.int64)

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        pairs = [
            (k, np.array([at[p] for p in np.frombuffer(r[3], "<i4").tolist()], dtype=np.int64))
            for k, r in enumerate(rows)
            if r[3]
        ]
        for (i, j), common in zip(pairs, _common(sets, pairs)):
            j = j[common / (sizes[i] + sizes[j] - common) >= threshold]
            if not len(j):
                continue
            links[i] += copies[j].sum()
            links[j] += copies[i]
            for k in j.tolist():
                a, b = root(i), root(k)
                if rows[a][2] > rows[b][2]:
                    a, b = b, a
                parent[b] = a
        for k in np.flatnonzero(links).tolist():
            yield rows[k][2], int(links[k]), rows[root(k)][2]
        del rows, sets, pairs  # before the next group is read


def _streamed(df: DataFrame, schema: pa.Schema, ddl: str, rows: Callable) -> DataFrame:
    """Apply ``rows`` to whole groups of the first column, as many in a task as there are.

    A group is two blocks at most, so no pandas call is needed for each of the many small ones.
    """
    order = [c for c in ("g", "block", "d") if c in df.columns]
    dealt = df.repartition("g").sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: arrow_rows(schema, rows(batches)), ddl)


def near_classes(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_links, d, first``.

    ``class_id`` is the smallest doc_id of the near duplicates joined by links, ``copy_id`` that of
    the documents with the same shingles, ``n_links`` the number of other documents whose
    similarity is at least ``threshold``. ``d`` is the digest of the shingles (null without words);
    ``first`` marks the documents that have their class's id and its shingles. Bands are made for
    thresholds of 0.8 or more.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the bands find pairs of {THRESHOLD} or more")
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    signed = staged(
        docs.mapInArrow(
            lambda batches: arrow_rows(SIGNED, _sign(batches, words)),
            "doc_id bigint, t bigint, d binary, sig binary",
        )
    )
    # A class's sets are read again from the rows with the id and text of one of its members.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("one")
    classes = staged(
        signed.filter("d is not null")
        .groupBy("d")
        .agg(one, F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig"))
        .select("d", F.col("one.doc_id").alias("copy_id"), F.col("one.t").alias("t"), "copies", "sig")
    )
    keys = F.array(
        *[F.concat(F.substring("sig", 1 + ROWS * b, ROWS), F.lit(bytes([b]))) for b in range(BANDS)]
    )
    banded = classes.select("d", F.explode(keys).alias("key"))
    # Buckets of two or more; of those with the same members (by two sums of hashes) the first band.
    sums = [F.sum(F.shiftright(F.xxhash64("d", F.lit(s)), 20)).alias(f"s{s}") for s in (1, 2)]
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums).filter("n > 1")
    band = F.conv(F.hex(F.substring("key", ROWS + 1, 1)), 16, 10).cast("int")
    kept = buckets.groupBy("n", "s1", "s2").agg(F.min_by("key", band).alias("key")).select("key", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("d", F.lit(3)), F.col("blocks")).cast("int")
    members = (
        banded.join(kept, "key")
        .join(classes.select("d", "sig"), "d")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.concat(
                "key", F.to_binary(F.lpad(F.hex(F.least("own", "other")), 8, "0"), F.lit("hex")),
                F.to_binary(F.lpad(F.hex(F.greatest("own", "other")), 8, "0"), F.lit("hex")),
            ).alias("g"),
            "d",
            "sig",
            (F.col("own") > F.col("other")).cast("int").alias("block"),
        )
    )
    keep = fewest_matches(threshold, tolerance)
    pruned = staged(
        _streamed(
            members,
            PAIRED,
            "g binary, place int, d binary, others binary",
            lambda batches: _prune(batches, keep),
        )
    )
    asked = pruned.select("d").distinct().join(classes.select("d", "copy_id", "t"), "d").select(
        F.col("copy_id").alias("_id"), F.col("t").alias("_t")
    )
    asked = staged(asked.distinct())
    same = (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = docs.join(F.broadcast(asked) if small(asked, BROADCAST_ROWS) else asked, same, "left_semi")
    sets = texts.select("text").mapInArrow(
        lambda batches: arrow_rows(SETS, _sets(batches, words)), "d binary, shingles binary"
    ).dropDuplicates(["d"])
    verified = staged(
        _streamed(
            pruned.join(sets, "d").join(classes.select("d", "copies"), "d").select(
                "g", "place", "d", "others", "shingles", "copies"
            ),
            LINKED,
            "d binary, links bigint, root binary",
            lambda batches: _verify(batches, threshold),
        )
    )
    found = components(verified.select(F.col("d").alias("u"), F.col("root").alias("v")))
    linked = verified.groupBy("d").agg(F.sum("links").alias("links"))
    rooted = classes.select("d", "copy_id", "copies").join(
        found.select(F.col("node").alias("d"), "root"), "d", "left"
    ).withColumn("root", F.coalesce("root", "d"))
    least = F.min(F.struct(F.col("copy_id").isNull().alias("no_id"), "copy_id", "d"))
    firsts = rooted.groupBy("root").agg(least.alias("first"))
    told = rooted.join(firsts, "root").join(linked, "d", "left").select(
        "d",
        F.col("first.copy_id").alias("class_id"),
        "copy_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("first.d") == F.col("d")).alias("leads"),
    )
    return signed.select("doc_id", "d").join(told, "d", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "d",
        (
            F.col("d").isNull()
            | (F.coalesce("leads", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("class_id")))
        ).alias("first"),
    )


def one_of_each(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the one with the smallest doc_id.

    Rows without words all stay. Where rows share a doc_id, or have none, their shingles tell which
    of them leads its class.
    """
    found = staged(near_classes(df, doc_id, text, words, threshold, tolerance))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("first"))
    single = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    _id, _d, _of = unused(df, "_id"), unused(df, "_d"), unused(df, "_of")
    gone = staged(
        ids.filter(~single | ~F.col("first")).select(F.col("doc_id").alias(_id), single.alias("single"))
    )
    key = F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col(_id))
    hint = F.broadcast if small(gone, BROADCAST_ROWS) else (lambda frame: frame)
    kept = df.join(hint(gone.select(_id)), key, "left_anti")
    shared = gone.filter("not single").select(_id)
    if small(shared, 0):
        return kept

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        sets = (shingles(t, words) for t in texts)
        return pd.Series([_digest(x) if len(x) else None for x in sets])

    lead = found.filter("first and d is not null").select(
        F.col("doc_id").alias(_id), F.col("d").alias(_d)
    )
    rows = df.join(hint(shared), key, "left_semi").withColumn(_of, digest(F.col(f"`{text}`")))
    some = rows.filter(F.col(_of).isNotNull()).join(
        lead.distinct(), key & (F.col(_of) == F.col(_d)), "left_semi"
    )
    one = some.dropDuplicates([doc_id, _of])
    return kept.unionByName(one.unionByName(rows.filter(F.col(_of).isNull())).drop(_of))
