"""Token ids in files of bit or byte planes (bit-plane shuffling).

A file holds the ids of consecutive documents, in ascending order of their ids. Its stream of ids
is cut into blocks of a fixed number of ids; each block is transposed into planes, byte j (or bit j)
of every id together, and each plane is compressed with zstandard. High planes are nearly constant
and shrink to nothing. The chunk index holds, per block, its number of ids and the length of each
compressed plane, so that any run of ids is read by decoding the blocks that it touches.

Files are rows of a Parquet table, one file a row: Spark's writer commits them, any store will do,
and a lost executor only costs its own files again.

    part, file_no place of the file: the range of documents, and the number in it
    in_part       ids of the range before this file
    n_ids         ids in the file
    doc_ids       its documents, ascending
    doc_lengths   ids of each
    block_ids     chunk index: ids of each block
    plane_bytes   chunk index: compressed length of each plane, block by block
    payload       the compressed planes, one after the other

Defined cases: a null or empty text has the end id only; documents that share a doc_id stand in
a fixed order of their texts, nulls first; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, sliced
from seqprep.llm.encode import encoder

BLOCK_IDS = 65_536
FILE_IDS = 1_000_000  # a file is closed once it has so many; one long document may make it longer
LEVEL = 3

FILES = pa.schema(
    [
        ("part", pa.int32()),
        ("file_no", pa.int32()),
        ("in_part", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("block_ids", pa.list_(pa.int32())),
        ("plane_bytes", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)
FILES_DDL = (
    "part int, file_no int, in_part bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "block_ids array<int>, plane_bytes array<int>, payload binary"
)
DOCS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block: 4 byte planes, or 32 bit planes padded to whole bytes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, j].tobytes() for j in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, j], bitorder="little").tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of a block from its planes; their number tells the kind."""
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
        return np.ascontiguousarray(octets).view("<u4").ravel()
    bits = np.stack(
        [np.unpackbits(np.frombuffer(p, np.uint8), count=n_ids, bitorder="little") for p in planes],
        axis=1,
    )
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def pack_file(
    ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL
) -> tuple[list[int], list[int], bytes]:
    """``block_ids, plane_bytes, payload`` of a stream of ids."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    counts, lengths, parts = [], [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        counts.append(len(block))
        for plane in to_planes(block, planes):
            parts.append(squeeze(plane))
            lengths.append(len(parts[-1]))
    return counts, lengths, b"".join(parts)


def read_run(
    block_ids: list[int], plane_bytes: list[int], payload: bytes, start: int, n: int
) -> np.ndarray:
    """``n`` ids of a file from ``start`` on, decoding only the blocks that hold them."""
    if n <= 0 or not len(block_ids):
        return np.empty(0, "<u4")
    each = len(plane_bytes) // len(block_ids)
    firsts = np.concatenate([[0], np.cumsum(block_ids)])
    offsets = np.concatenate([[0], np.cumsum(plane_bytes)])
    expand = zstandard.ZstdDecompressor().decompress
    lo = int(np.searchsorted(firsts, start, "right")) - 1
    hi = int(np.searchsorted(firsts, start + n, "left"))
    found = []
    for b in range(lo, hi):
        at = offsets[b * each : (b + 1) * each + 1]
        planes = [expand(payload[at[j] : at[j + 1]]) for j in range(each)]
        found.append(from_planes(planes, int(block_ids[b])))
    return np.concatenate(found)[start - firsts[lo] : start - firsts[lo] + n]


def _encoded_files(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, planes: str, block_ids: int,
    level: int, file_ids: int,
) -> Iterator[tuple]:
    """File rows from sorted documents; holds one file at a time."""
    part = TaskContext.get().partitionId()
    end = int(end_id).to_bytes(4, "little")
    number, before = 0, 0
    doc_ids: list[int | None] = []
    parts: list[bytes] = []

    def finished() -> tuple:
        ids = np.frombuffer(b"".join(parts), "<u4")
        lengths = [len(p) // 4 for p in parts]
        return (
            part, number, before, len(ids), list(doc_ids), lengths,
            *pack_file(ids, planes, block_ids, level),
        )

    held = 0
    for batch in (part for whole in batches for part in sliced(whole)):
        keys = batch.column("doc_id").to_pylist()
        for key, ids in zip(keys, encoder(tokenizer).encode(batch.column("text").to_pylist())):
            doc_ids.append(key)
            parts.append(ids + end)
            held += len(parts[-1]) // 4
            if held >= file_ids:
                yield finished()
                number, before, held = number + 1, before + held, 0
                doc_ids.clear()
                parts.clear()
    if parts:
        yield finished()


def write_planes(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    level: int = LEVEL,
    file_ids: int = FILE_IDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every whole text, end it with ``end_id`` and write the files under ``path``.

    Spark deals the documents to ranges of their ids and sorts them there; the task that encodes
    them writes the files, so texts move once and ids not at all.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes is 'byte' or 'bit'")
    docs = needed(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    made = (
        docs.repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .mapInArrow(
            lambda batches: arrow_rows(
                FILES, _encoded_files(batches, tokenizer, end_id, planes, block_ids, level, file_ids)
            ),
            FILES_DDL,
        )
    )
    made.write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            ids = read_run(row["block_ids"], row["plane_bytes"], row["payload"], 0, row["n_ids"])
            data, at = ids.tobytes(), 0
            for key, n in zip(row["doc_ids"], row["doc_lengths"]):
                yield key, row["first"] + at, n, data[4 * at : 4 * (at + n)]
                at += n


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files under ``path``: ``doc_id, start, n_tokens, ids`` (32-bit bytes).

    ``start`` is the number of ids of all documents before. Files know their place within their
    range of documents; the totals of the ranges (one row for each task that wrote) add the rest.
    """
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    ranges = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("past"))
    placed = files.join(F.broadcast(ranges), "part").withColumn(
        "first", F.col("past") + F.col("in_part")
    )
    needed_columns = ["first", "n_ids", "doc_ids", "doc_lengths", "block_ids", "plane_bytes", "payload"]
    return placed.select(*needed_columns).mapInArrow(
        lambda batches: arrow_rows(DOCS, _documents(batches)),
        "doc_id bigint, start bigint, n_tokens bigint, ids binary",
    )
