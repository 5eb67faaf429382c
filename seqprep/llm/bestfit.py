"""Vector best-fit packing of token sequences.

A bin (a training sequence) has three capacities: tokens, documents and attention cost (the sum of
squared lengths). Pieces are placed from the longest down. Of the open bins in which a piece fits
under every constraint, the one with the best score takes it, by the residual capacities, each as
a share of the whole capacity:

    "norm"  the smallest weighted norm of what is left after placing
    "dot"   the largest weighted dot product of the piece with what is left before placing

A piece that fits nowhere opens a bin. Documents longer than a bin are cut into full pieces and a
last one; full pieces are bins of their own at once. The rest is dealt by a hash of the document
and of its row, so that equal rows part, to cells of a fixed size, each packed by one task, which costs at most about one open bin a cell.

Defined cases: a null or empty text has the end id only; repeated rows are pieces of their own;
ties go to the oldest bin, and equal pieces are placed in the order of doc_id, piece and text hash;
an empty table packs to nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import arrow_rows, needed, pieces_of, sliced
from seqprep.llm.encode import encoder

CELL_PIECES = 16_384
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("copy", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = "doc_id bigint, copy bigint, piece int, start bigint, length bigint, ids binary"


def best_fit(
    lengths: Sequence[int],
    tokens: int,
    documents: int,
    cost: float,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> tuple[np.ndarray, np.ndarray]:
    """``bin, offset`` of each piece, given in placing order (longest first).

    Open bins are kept as one array of what is left of each capacity; a bin that cannot take even
    the shortest piece is closed, so the search stays short.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.max() > tokens or float(lengths.max()) ** 2 > cost or documents < 1):
        raise ValueError("a piece is larger than an empty bin")
    scale = np.array([tokens, documents, cost], dtype=float)
    pull = np.array(weights, dtype=float)
    shortest = int(lengths.min()) if len(lengths) else 0
    least = np.array([shortest, 1, float(shortest) ** 2])
    left = np.empty((1024, 3))
    number = np.empty(1024, dtype=np.int64)
    n_open, n_bins = 0, 0
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) ** 2])
        rest = left[:n_open]
        fits = np.flatnonzero(
            (rest[:, 0] >= need[0]) & (rest[:, 1] >= need[1]) & (rest[:, 2] >= need[2])
        )
        if len(fits):
            share = rest[fits] / scale
            if rule == "dot":
                best = fits[np.argmax(share @ (pull * need / scale))]
            else:
                best = fits[np.argmin(((share - need / scale) ** 2) @ pull)]
        else:
            if n_open == len(left):
                left, number = np.resize(left, (2 * n_open, 3)), np.resize(number, 2 * n_open)
            best = n_open
            left[best], number[best] = scale, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i] = number[best]
        offsets[i] = tokens - int(left[best, 0])
        left[best] -= need
        if (left[best] < least).any():  # nothing fits any more; keep the age order of the others
            left[best : n_open - 1] = left[best + 1 : n_open].copy()
            number[best : n_open - 1] = number[best + 1 : n_open].copy()
            n_open -= 1
    return bins, offsets


def _cut(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, tokens: int
) -> Iterator[tuple]:
    end = int(end_id).to_bytes(4, "little")
    for batch in (part for whole in batches for part in sliced(whole)):
        keys, copies = batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist()
        texts = batch.column("text").to_pylist()
        for key, copy, ids in zip(keys, copies, encoder(tokenizer).encode(texts)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[at : at + 4 * tokens]
                yield key, copy, piece, at // 4, len(part) // 4, part


def cut_pieces(
    df: DataFrame, tokenizer: str, end_id: int, tokens: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most ``tokens`` ids: ``doc_id, copy, piece, start, length, ids``.

    ``copy`` is a hash of the text, which tells documents of the same doc_id apart.
    """
    docs = needed(df, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("copy"), "text"
    )
    return docs.mapInArrow(
        lambda batches: arrow_rows(PIECES, _cut(batches, tokenizer, end_id, tokens)), PIECES_DDL
    )


def assign(
    pieces: DataFrame,
    tokens: int,
    documents: int | None = None,
    cost: float | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    cell_pieces: int = CELL_PIECES,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to narrow piece rows; give a written table.

    Wide columns such as ``ids`` should be left out and joined afterwards, or derived before.
    Without a limit on documents or cost these constraints never bind.
    """
    documents = tokens if documents is None else documents
    cost = float(tokens) ** 2 if cost is None else cost
    full = (F.col("length") >= tokens) | (F.lit(documents) == 1)
    n_cells = pieces_of(pieces.filter(~full).count(), cell_pieces)
    cell = F.when(full, F.lit(None)).otherwise(
        F.pmod(F.xxhash64("doc_id", "copy", "piece", F.monotonically_increasing_id()), F.lit(n_cells))
    )
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn(
        "offset", F.lit(0).cast("bigint")
    ).schema

    def pack_cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values(
            ["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True],
            kind="stable", na_position="first",
        )
        bins, offsets = best_fit(order["length"], tokens, documents, cost, rule, weights)
        order["sequence_id"] = bins * n_cells + int(key[0])
        order["offset"] = offsets
        return order[schema.names]

    alone = pieces.filter(full).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),  # never a packed bin's
        F.lit(0).cast("bigint").alias("offset"),
    )
    rest = pieces.filter(~full).withColumn("_cell", cell.cast("bigint"))
    return rest.groupBy("_cell").applyInPandas(pack_cell, schema).unionByName(alone)

