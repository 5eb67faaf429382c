"""Token ids: the encoder, byte and bit planes, best-fit packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqprep.llm import bestfit, planes
from seqprep.llm.common import scratch_dir, staged
from seqprep.llm.encode import encoder
from seqprep.llm.queries import QUERIES

from .conftest import HOSTILE

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return encoder(PATH).whole(text)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBé ß,.;'#1ñ\n\t́ΣİЖ日<|>%\x85\xa0\xad")), max_size=40))
def test_words_have_the_ids_of_whole_texts(text):
    (found,) = encoder(PATH).encode([text])
    assert np.frombuffer(found, "<u4").tolist() == plain(text)


def test_encoder_keeps_few_bytes():
    """100,000 different paragraphs without a space: the ids are right, the cache stays small."""
    import sys

    from seqprep.llm.encode import KEPT_BYTES, WordEncoder

    draw = np.random.default_rng(3)
    made = WordEncoder(PATH)
    signs = [chr(0x4E00 + k) for k in range(2000)]
    for at in range(0, 100_000, 1000):
        texts = ["".join(draw.choice(signs, 40 + 60 * (k % 2))) for k in range(1000)]
        found = list(made.encode(texts))
        if at % 20_000 == 0:
            assert np.frombuffer(found[0], "<u4").tolist() == plain(texts[0])
    held = [made._words, made._words._old]
    size = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in held)
    assert all(d.held <= KEPT_BYTES + 10_000 for d in held if d) and size < 150 << 20


def test_tokenizer_that_does_not_work_by_words_is_refused(tmp_path):
    from tokenizers import Tokenizer

    from seqprep.llm.encode import WordEncoder

    other = Tokenizer.from_file(PATH)
    other.normalizer = None
    other.save(f"{tmp_path}/other.json")
    with pytest.raises(ValueError):
        WordEncoder(f"{tmp_path}/other.json")


def test_encoder_over_documents(texts):
    some = list(texts.values())
    for text, found in zip(some, encoder(PATH).encode(some)):
        assert np.frombuffer(found, "<u4").tolist() == plain(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    counts, lengths, payload = planes.pack_file(ids, kind, block_ids=64)
    assert sum(counts) == n and sum(lengths) == len(payload)
    assert planes.read_run(counts, lengths, payload, 0, n).tolist() == ids.tolist()
    if n > 100:  # any run, across blocks
        assert planes.read_run(counts, lengths, payload, 60, 77).tolist() == ids[60:137].tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_of_hostile_documents(spark, hostile, kind):
    path = scratch_dir(spark)
    planes.write_planes(hostile, path, PATH, end_id=1, planes=kind, block_ids=100, file_ids=500)
    rows = planes.read_planes(spark, path).orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    expected = sorted((k is None, k or 0, crc([*plain(t), 1])) for k, t, *_ in HOSTILE)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in rows) == expected
    past = 0
    for r in rows:
        assert r["start"] == past and r["n_tokens"] * 4 == len(r["ids"])
        past += r["n_tokens"]


def test_op1(spark, sf_dir, texts):
    past = 0
    rows = QUERIES["op1_planes"](spark, sf_dir).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        ids = [*plain(texts[r["doc_id"]]), 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (past, len(ids), crc(ids))
        past += len(ids)


def valid_bins(lengths, bins, offsets, tokens, documents, cost):
    at = {}
    for length, b, offset in zip(lengths, bins.tolist(), offsets.tolist()):
        used, n, paid = at.get(b, (0, 0, 0))
        assert offset == used
        at[b] = (used + length, n + 1, paid + length**2)
    return all(u <= tokens and n <= documents and c <= cost for u, n, c in at.values()), len(at)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(1, 100), max_size=80),
    st.integers(1, 6), st.integers(10_000, 20_000), st.sampled_from(["norm", "dot"]),
)
def test_best_fit_keeps_every_constraint(lengths, documents, cost, rule):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = bestfit.best_fit(lengths, 100, documents, cost, rule)
    fine, n = valid_bins(lengths, bins, offsets, 100, documents, cost)
    assert fine and n >= -(-sum(lengths) // 100)


def test_best_fit_chooses_the_fullest_bin_that_fits():
    bins, _ = bestfit.best_fit([60, 50, 40, 35, 5], 100, 10, 10_000)
    assert bins.tolist() == [0, 1, 0, 1, 1]


def test_best_fit_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        bestfit.best_fit([11], 10, 5, 1000)
    with pytest.raises(ValueError):
        bestfit.best_fit([9], 10, 5, 80)


def check_packing(rows, documents, tokens):
    """Pieces cut as promised, gapless bins, nothing lost."""
    pieces = {}
    bins = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
    expected = []
    for key, text in documents:
        ids = [*plain(text), 0]
        for n, at in enumerate(range(0, len(ids), tokens)):
            expected.append((key is None, key or 0, n, at, min(tokens, len(ids) - at), crc(ids[at : at + tokens])))
    found = [
        (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows
    ]
    assert sorted(found) == sorted(expected)
    return len(bins)


def test_packing_of_hostile_documents(spark, hostile):
    pieces = staged(
        bestfit.cut_pieces(hostile, PATH, 0, 64).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    )
    for cell in (3, 10_000):
        rows = bestfit.assign(pieces, 64, cell_pieces=cell).collect()
        check_packing(rows, [(k, t) for k, t, *_ in HOSTILE], 64)
    few = bestfit.assign(pieces, 64, documents=2).collect()
    held = {}
    for r in few:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + 1
    assert max(held.values()) <= 2


def test_op3(spark, sf_dir, texts):
    rows = QUERIES["op3_bestfit"](spark, sf_dir).collect()
    bins = check_packing(rows, list(texts.items()), 2048)
    assert bins <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_empty_tables(spark, hostile):
    none = hostile.limit(0)
    path = scratch_dir(spark)
    planes.write_planes(none, path, PATH, end_id=1)
    assert planes.read_planes(spark, path).count() == 0
    pieces = staged(bestfit.cut_pieces(none, PATH, 0, 64).drop("ids"))
    assert bestfit.assign(pieces, 64).count() == 0


def test_equal_rows_part(spark):
    """A third of all pieces and documents are equal rows: no cell, and no window of slots, holds them all."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, null, concat('w', id)) as text")
    pieces = staged(bestfit.cut_pieces(rows, PATH, 0, 64).drop("ids"))
    packed = bestfit.assign(pieces, 64, cell_pieces=100)
    equal = packed.filter("doc_id is null").groupBy((F.col("sequence_id") % 60).alias("cell")).count()
    assert equal.agg(F.max("count")).first()[0] < 100 and packed.count() == 6000
