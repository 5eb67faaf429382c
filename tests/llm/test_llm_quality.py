"""Subword classifier: features against plain loops, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pytest

from seqprep.llm import subwords
from seqprep.llm.common import table


def all_features(text):
    parts = list(subwords.features(text))
    return sorted(np.concatenate(parts).tolist()) if parts else []


def plain_features(text):
    """The same features by loops over words and characters, with numpy's 64-bit arithmetic."""
    mix, found, before = int(subwords._MIX), [], None
    low = (1 << 64) - 1

    def bucket(value):
        value ^= value >> 29
        return (value * mix & low) >> 48

    for word in (text or "").split():
        power, value = 1, 0
        for c in word:
            power = power * (mix | 1) & low
            value = (value + (ord(c) + 1) * power) & low
        value ^= value >> 31
        found.append(bucket(value))
        if before is not None:
            found.append(bucket(int(subwords._REPEAT) if before == value else (before * int(subwords._PAIR) + value) & low))
        before = value
        marked = f" {word} "
        for n in subwords.GRAMS:
            for i in range(len(marked) - n + 1):
                rolled = ord(marked[i]) + 7
                for c in marked[i + 1 : i + n]:
                    rolled = (rolled * mix + ord(c)) & low
                found.append(bucket(rolled * (2 * n + 1) & low))
    return sorted(found)


@pytest.mark.parametrize("text", [
    None, "", " \n\t ", "a", "a a a", "Ab, cd! x", "日本語 é😀 next", "same same\nother  same", "x" * 50,
])
def test_features_equal_plain_loops(text):
    assert all_features(text) == plain_features(text)


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc ccc", "dddd\n", "é"], k=400))
    whole = all_features(text)
    monkeypatch.setattr(subwords, "PIECE", 37)
    assert all_features(text) == whole == plain_features(text)


def test_held_out_accuracy(spark, sf_dir):
    from seqprep.llm.queries import QUERIES

    rows = {r["doc_id"]: r for r in QUERIES["op13_subwords"](spark, "/root/testdata/sf0.01").collect()}
    labels = table(spark, "/root/testdata/sf0.01", "labels").collect()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    told = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert len(told) > 50 and sum(a == b for a, b in told) / len(told) >= 0.95


def test_scores_are_those_of_vectors_and_softmax():
    """Margins of features give what averaging vectors and a softmax give."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(60):
        found = np.concatenate(list(subwords.features(("good words " if i % 2 else "BAD!! ") * (3 + i % 4))))
        buckets, n = np.unique(found, return_counts=True)
        rows.append((buckets, (n / n.sum()).astype(np.float32), i % 2))
    vectors, out, bias = subwords.fit(rows, epochs=3)
    model = subwords.Model((vectors @ (out[1] - out[0])).astype("<f4"), float(bias[1] - bias[0]))
    for text in ("good words", "BAD!! good", "other", " ".join(draw.choice(["a", "b"], 40))):
        found = np.concatenate(list(subwords.features(text)))
        logits = out @ vectors[found].mean(axis=0) + bias
        odds = np.exp(logits - logits.max())
        assert model.score(text) == pytest.approx(float(odds[1] / odds.sum()), abs=1e-4)
    assert model.score("good words good words") > 0.5 > model.score("BAD!! BAD!!")


def test_hostile_documents(spark, hostile):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (2, 1), (4, 1), (5, 0), (7, 1), (9, None), (None, 1), (8, 3), (77, 1)], "doc_id bigint, quality int"
    )
    model = subwords.train(hostile, labels)
    rows = subwords.score(hostile, model).collect()
    assert len(rows) == hostile.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (4, 5)}
    assert empty == {model.score("")}
    assert subwords.score(hostile.limit(0), model).count() == 0
    none = subwords.train(hostile, labels.limit(0))
    assert {r["score"] for r in subwords.score(hostile, none).collect()} == {0.5}
    good = subwords.train(hostile, labels.filter("quality = 1 and doc_id <> 2"))
    assert all(r["score"] > 0.99 for r in subwords.score(hostile, good).collect())


def test_training_does_not_depend_on_partitions(spark, documents, sf_dir):
    labels = table(spark, sf_dir, "labels")
    one, many = (subwords.train(documents.repartition(n), labels, sample=60) for n in (1, 7))
    assert np.array_equal(one.margins, many.margins) and one.bias == many.bias
