"""Distributed positional inverted index, and phrase search for benchmark decontamination.

The index is cut by documents into segments of a bounded number of words. A segment is the unit of
work: its postings (term, and the places of the term in the segment) are rows of the index table,
and so is its directory (the documents and where each starts), under the empty term. A common term
therefore has one bounded row a segment, never one list for the corpus.

A search takes its phrases from the rarest term outwards. Corpus counts of the phrases' terms come
from the index; a phrase is looked for only in segments that hold its rarest term; there the lists
of its terms, each shifted by the term's place in the phrase, are intersected from the rarest on.
With ``slop`` a term may stand up to so many words from its place (a proximity match).

Words are runs of digits, a-z and all characters beyond ASCII, after lower-casing A-Z.

Defined cases: a null or empty text has no words and no match; a phrase with a term that the corpus
lacks is in no document; repeated documents match each by itself; an item without an id is searched
for like any other and counts in ``n_hit``, has no label, and is told by ``unnamed``; an empty index or an empty list
of phrases gives documents without matches, or no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.llm.common import LOWER, UPPER, lower_ascii, needed, only_cache, small, staged

SEGMENT_WORDS = 2_000_000  # a segment is closed once it has so many places; a longer document is one segment
GAP = 64  # places between documents, so that no phrase of so many words reaches into the next one
BROADCAST_ROWS = 200_000  # terms or phrases, at most some 30 MB
DIRECTORY = ""  # the term of a segment's directory row; never a word
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = pa.schema(
    [
        ("segment", pa.int64()),
        ("term", pa.string()),
        ("n_occ", pa.int64()),
        ("places", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_words", pa.list_(pa.int32())),
    ]
)
INDEX_DDL = (
    "segment bigint, term string, n_occ bigint, places binary, doc_ids array<bigint>, "
    "doc_words array<int>"
)
FOUND_DDL = "segment bigint, nth bigint, n_hit bigint, ids array<bigint>, starts array<int>"

# What stands between words becomes a space, A-Z becomes a-z.
_SEPARATED = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER
    else b if b >= 128 or chr(b) in LOWER or chr(b).isdigit() else 32
    for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_SEPARATED).split() if text else []


def words(text: Column) -> Column:
    """The same words as a column, for short tables."""
    return F.coalesce(
        F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>")
    )


def _deltas(places: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each term's places as differences; ``firsts`` marks where its list begins."""
    found = np.diff(places, prepend=np.int32(0))
    found[firsts] = places[firsts]
    return found


def _segment(
    segment: int, terms: list[bytes], runs: list[np.ndarray], doc_ids: list[int | None], gap: int
) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(r) for r in runs], dtype=np.int32)
    starts = np.cumsum(lengths + gap, dtype=np.int64) - lengths - gap
    directory = [
        pa.array([segment]), pa.array([DIRECTORY]), pa.array([gap]),
        pa.array([starts.astype("<i4").tobytes()], pa.binary()),
        pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
    ]
    yield pa.RecordBatch.from_arrays(directory, schema=INDEX)
    if not terms:
        return
    ids = np.concatenate(runs)
    counts = np.bincount(ids, minlength=len(terms))
    order = np.argsort(ids, kind="stable").astype(np.int32)
    del ids
    # The place of the k-th word is k and the gaps of the documents before its own.
    places = np.arange(len(order), dtype=np.int32)
    places += np.repeat(gap * np.arange(len(lengths), dtype=np.int32), lengths)
    firsts = np.cumsum(counts) - counts
    data = _deltas(places[order], firsts).astype("<i4")
    del places, order
    step = 100_000  # rows of a batch
    for at in range(0, len(terms), step):
        n = counts[at : at + step]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype("<i4") * 4
        part = data[firsts[at] : firsts[at] + int(n.sum())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(n), segment)),
                pa.array(terms[at : at + step], pa.binary()).cast(pa.string()),
                pa.array(n.astype(np.int64)),
                pa.BinaryArray.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes())]
                ),
                pa.nulls(len(n), pa.list_(pa.int64())),
                pa.nulls(len(n), pa.list_(pa.int32())),
            ],
            schema=INDEX,
        )


def _segments(batches: Iterator[pa.RecordBatch], segment_words: int, gap: int) -> Iterator[pa.RecordBatch]:
    only_cache("positions")
    part, nth, held = TaskContext.get().partitionId(), 0, 0
    terms: dict[bytes, int] = defaultdict()
    terms.default_factory = terms.__len__
    runs: list[np.ndarray] = []
    doc_ids: list[int | None] = []
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = list(map(terms.__getitem__, split_words(text.as_py())))
            runs.append(np.array(found, dtype=np.int32))
            doc_ids.append(key)
            held += len(found) + gap
            if held >= segment_words:
                yield from _segment((part << 32) + nth, list(terms), runs, doc_ids, gap)
                nth, held = nth + 1, 0
                terms.clear()
                runs.clear()
                doc_ids.clear()
    if runs:
        yield from _segment((part << 32) + nth, list(terms), runs, doc_ids, gap)


def write_index(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
    segment_words: int = SEGMENT_WORDS, gap: int = GAP,
) -> None:
    """Write the index of whole texts to ``path``. Nothing is shuffled: a task indexes what it reads.

    Phrases of up to ``gap`` words, slop included, can be looked for in it.
    """
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs.mapInArrow(lambda batches: _segments(batches, segment_words, gap), INDEX_DDL).write.parquet(path)


def windows(
    items: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """``phrase, label``: every run of ``size`` words of an item, a row for each item that has it.

    An item of fewer words, but not none, is one phrase. Items without an id have a null label.
    """
    found = needed(items, item_id=item_id, text=text).select(
        F.col("item_id").cast("string").alias("label"), words(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    runs = found.select("label", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return runs.select("label", F.slice("w", F.col("at"), size).alias("phrase")).distinct()


def _near(wanted: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have one of the sorted ``places`` within ``slop``."""
    at = np.searchsorted(places, wanted - slop)
    inside = at < len(places)
    return inside & (places[np.minimum(at, len(places) - 1)] <= wanted + slop)


def _match(postings: pd.DataFrame, phrases: pd.DataFrame, slop: int) -> pd.DataFrame:
    """Documents of one segment with matches."""
    empty = pd.DataFrame({"segment": [], "nth": [], "n_hit": [], "ids": [], "starts": []}, dtype=object)
    if postings.empty or phrases.empty:
        return empty
    lists = {
        term: np.cumsum(np.frombuffer(data, "<i4"), dtype=np.int64) if term != DIRECTORY
        else np.frombuffer(data, "<i4").astype(np.int64)
        for term, data in zip(postings["term"], postings["places"])
    }
    starts = lists.pop(DIRECTORY)
    row = postings[postings["term"] == DIRECTORY].iloc[0]
    lengths = np.asarray(row["doc_words"], dtype=np.int64)
    hit = np.zeros(int(starts[-1] + lengths[-1]) + GAP, dtype=bool)
    ids: dict[int, set[int]] = defaultdict(set)
    at: dict[int, list[int]] = defaultdict(list)
    for terms, phrase in zip(phrases["terms"], phrases["id"]):
        size, found = len(terms), None
        for t in terms:
            places = lists.get(t["term"])
            if places is None:
                found = None
                break
            if found is None:
                found = places - t["place"]
            else:
                found = found[_near(found + t["place"], places, slop)]
            if not len(found):
                break
        if found is None or not len(found):
            continue
        nth = np.searchsorted(starts, np.maximum(found, 0), "right") - 1
        inside = found - starts[nth]
        keep = (inside >= 0) & (inside < lengths[nth])
        for doc, place in zip(nth[keep].tolist(), inside[keep].tolist()):
            ids[doc].add(phrase)
            at[doc].append(place)
            low = int(starts[doc]) + place
            hit[low : min(low + size, int(starts[doc] + lengths[doc]))] = True
    if not ids:
        return empty
    total = np.concatenate([[0], np.cumsum(hit)])
    docs = sorted(ids)
    segment = int(row["segment"])
    return pd.DataFrame(
        {
            "segment": segment,
            "nth": docs,
            "n_hit": [int(total[starts[d] + lengths[d]] - total[starts[d]]) for d in docs],
            "ids": [sorted(ids[d]) for d in docs],
            "starts": [sorted(set(at[d])) for d in docs],
        }
    )


def search(spark: SparkSession, path: str, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Every document of the index: ``doc_id, n_words, n_hit, labels, starts, unnamed``.

    ``n_hit`` counts words inside matches, ``labels`` are those of the phrases found, ``starts`` the
    places (in words, from 0) where matches begin, ``unnamed`` whether a phrase found has an item
    without an id. ``phrases`` has ``phrase`` (array of words) and ``label``, a row for each pair, and any
    number of rows: phrases and postings move by segment, labels are joined to what was found.
    """
    index = spark.read.parquet(path)
    asked = staged(phrases.select("phrase", "label", F.xxhash64("phrase").alias("id")))
    each = asked.select("id", "phrase").distinct()
    longest = asked.agg(F.max(F.size("phrase"))).first()[0] or 0
    gap = index.filter(F.col("term") == DIRECTORY).agg(F.min("n_occ")).first()[0] or GAP
    if longest + slop > gap:
        raise ValueError(f"phrase and slop together may have {gap} words at most: the gap of the index")
    parts = each.select("id", F.posexplode("phrase").alias("place", "term"))
    terms = parts.select("term").distinct()
    listed = index.filter(F.col("term") != DIRECTORY)
    held = listed.join(F.broadcast(terms) if small(terms, BROADCAST_ROWS) else terms, "term", "left_semi")
    counts = staged(held.groupBy("term").agg(F.sum("n_occ").alias("n")))
    # Rarest first; a phrase with a term that is nowhere goes.
    ordered = (
        parts.join(counts, "term")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("terms"))
        .join(each, "id")
        .filter(F.size("terms") == F.size("phrase"))
        .select(F.col("terms")[0]["term"].alias("term"), "id", "terms")
    )
    ordered = staged(ordered)
    rare = F.broadcast(ordered) if small(ordered, BROADCAST_ROWS) else ordered
    active = staged(listed.select("segment", "term").join(rare, "term").drop("term"))
    wanted = active.select("segment", F.explode("terms.term").alias("term")).distinct()
    directories = active.select("segment").distinct().withColumn("term", F.lit(DIRECTORY))
    # Only rows of the phrases' terms move; most terms of a corpus are in no phrase.
    asked_terms = terms.unionByName(spark.createDataFrame([(DIRECTORY,)], "term string"))
    kept = index.join(
        F.broadcast(asked_terms) if small(terms, BROADCAST_ROWS) else asked_terms, "term", "left_semi"
    )
    postings = kept.join(wanted.unionByName(directories), ["segment", "term"], "left_semi").select(
        "segment", "term", "places", "doc_words"
    )
    found = (
        postings.groupBy("segment")
        .cogroup(active.select("segment", "terms", "id").groupBy("segment"))
        .applyInPandas(lambda a, b: _match(a, b, slop), FOUND_DDL)
    )
    found = staged(found)
    names = asked.select("id", "label")
    names = F.broadcast(names) if small(names, BROADCAST_ROWS) else names
    named = (
        found.select("segment", "nth", F.explode("ids").alias("id"))
        .join(names, "id")
        .groupBy("segment", "nth")
        .agg(
            F.sort_array(F.collect_set("label")).alias("labels"),
            F.bool_or(F.col("label").isNull()).alias("unnamed"),
        )
    )
    found = found.drop("ids").join(named, ["segment", "nth"])
    docs = index.filter(F.col("term") == DIRECTORY).select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("nth", "d")
    )
    none = F.array().cast("array<string>")
    return docs.withColumn("nth", F.col("nth").cast("bigint")).join(found, ["segment", "nth"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.doc_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("starts", F.array().cast("array<int>")).alias("starts"),
        F.coalesce("unnamed", F.lit(False)).alias("unnamed"),
    )
