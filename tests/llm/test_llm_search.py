"""Positional index, Jaccard join, hash-prefix forest: against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqprep.llm import forest, jaccard, positions
from seqprep.llm.common import LOWER, UPPER, scratch_dir, staged
from seqprep.llm.components import components
from seqprep.llm.queries import QUERIES, SQL

from .conftest import HOSTILE, WORDS

LOWERED = str.maketrans(UPPER, LOWER)


def words(text):
    return re.findall(positions.WORD, (text or "").translate(LOWERED))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_words_are_those_of_the_pattern(text):
    if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert [w.decode() for w in positions.split_words(text)] == words(text)


def plain_search(documents, items, size, slop=0):
    """n_words, n_hit and items of each document, by looking at every place."""
    phrases = defaultdict(set)
    for key, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1 if w else 0)):
            phrases[tuple(w[i : i + size])].add(str(key))
    for key, text in documents:
        w, hit, labels = words(text), set(), set()
        for n in {len(p) for p in phrases} if not slop else ():
            for i in range(len(w) - n + 1):
                if names := phrases.get(tuple(w[i : i + n])):
                    labels |= names
                    hit |= set(range(i, i + n))
        for phrase, names in phrases.items() if slop else ():
            for i in range(-slop, len(w)):
                near = [
                    any(0 <= j < len(w) and w[j] == t for j in range(i + o - slop, i + o + slop + 1))
                    for o, t in enumerate(phrase)
                ]
                if all(near) and i >= 0:
                    labels |= names
                    hit |= set(range(i, min(i + len(phrase), len(w))))
        yield key, len(w), len(hit), sorted(labels)


ITEMS = [
    (1, WORDS), (2, "brown fox jumps"), (10, "Lazy DOG, while"), (3, None), (4, ""), (5, "nowhere to be found"),
    (None, "quick brown"), (6, "brown fox jumps"), (7, "12"),
]


@pytest.mark.parametrize("size, slop", [(10, 0), (3, 0), (3, 1)])
def test_search_of_hostile_documents(spark, hostile, size, slop):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("term", F.lit(1))
    path = scratch_dir(spark)
    positions.write_index(hostile.repartition(2), path, segment_words=40)
    found = positions.search(spark, path, positions.windows(items, size), slop).collect()
    short = [(k, t) for k, t, *_ in HOSTILE if len(t or "") < 1000]
    expected = list(plain_search(short, [i for i in ITEMS if i[0] is not None], size, slop))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    seen = [(r["doc_id"], r["n_words"], r["n_hit"], r["labels"]) for r in found if r["n_words"] < 1000]
    assert sorted(seen, key=key) == sorted(expected, key=key)
    assert sum(r["n_words"] == 60_000 for r in found) == 1


def test_search_with_nothing(spark, hostile):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for docs, asked, n in ((hostile, items.limit(0), len(HOSTILE)), (hostile.limit(0), items, 0)):
        path = scratch_dir(spark)
        positions.write_index(docs, path)
        rows = positions.search(spark, path, positions.windows(asked)).collect()
        assert len(rows) == n and not any(r["n_hit"] for r in rows)
    long = spark.createDataFrame([(1, f"{WORDS} " * 4)], "item_id bigint, text string")
    with pytest.raises(ValueError):
        positions.search(spark, path, positions.windows(long, 60), slop=10)


def test_op8_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(SQL["op8_positions"])
    names = [d[0] for d in found.description]
    rows = QUERIES["op8_positions"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())
    assert any(r["contaminated"] for r in rows)
    clean = next(r for r in rows if not r["contaminated"])
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_items_without_an_id_are_searched_for(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"x {item} y"), (2, "alpha beta gamma"), (3, f"{item} and one two three")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(None, item), (None, "one two"), (8, item + " lambda"), (9, "two three")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.execute(SQL["op8_positions"])
    names = [d[0] for d in found.description]
    rows = QUERIES["op8_positions"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())
    assert {r["doc_id"]: r["n_hit"] for r in rows} == {1: 10, 2: 0, 3: 13}


def plain_classes(documents, threshold=0.8):
    """Class and number of links per row, comparing all pairs."""
    sets = [set(jaccard.shingles(t).tolist()) for _, t in documents]
    root = list(range(len(sets)))
    links = [0] * len(sets)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(documents):
        if sets[k]:
            least[find(k)] = min(key, least.get(find(k), key))
    return [(key, least[find(k)] if sets[k] else key, links[k]) for k, (key, _) in enumerate(documents)]


def edited(n, changes):
    """Texts of one family, each with a few words of its own."""
    base = [f"word{i}" for i in range(120)]
    for k in range(n):
        own = list(base)
        for c in range(k % (changes + 1)):
            own[(37 * c + 11 * k) % 120] = f"own{k}x{c}"
        yield " ".join(own)


def test_jaccard_of_hostile_documents(spark, hostile):
    rows = [(k, t) for k, t, *_ in HOSTILE if k is not None]
    found = jaccard.near_classes(hostile.filter("doc_id is not null"))
    seen = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found.collect())
    assert seen == sorted(plain_classes(rows))
    assert jaccard.near_classes(hostile).count() == len(HOSTILE)


def test_near_copies_without_an_id(spark):
    family, others = list(edited(3, 2)), [t.replace("word", "term") for t in edited(4, 3)]
    rows = [(None, family[0]), (None, family[1]), (None, family[1]), (None, others[0]), (5, others[1]), (4, others[2])]
    df = spark.createDataFrame([*rows, (None, None), (None, "by itself")], "doc_id bigint, text string")
    found = jaccard.near_classes(df).select("doc_id", "class_id", "n_links").collect()
    seen = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in found))
    links = [n for *_, n in plain_classes([(k or 0, t) for k, t in rows])]
    told = [(0, 0, n) for n in links[:3]] + [(0, 4, links[3]), (5, 4, links[4]), (4, 4, links[5]), (0, 0, 0), (0, 0, 0)]
    assert seen == sorted(told) and min(links) > 0
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect()]
    assert len(kept) == 4 and (4, others[2]) in kept and (None, None) in kept and (None, "by itself") in kept


def test_jaccard_of_a_family_in_many_blocks(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate([*edited(90, 4), *edited(30, 2), "alone in the world of words"])]
    expected = plain_classes(rows)
    assert 0 < sum(n for *_, n in expected) / 2 < 120 * 119 / 2  # some pairs are below the threshold
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.near_classes(df).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    monkeypatch.setattr(jaccard, "DENSE", 500)  # matrices in parts
    again = jaccard.near_classes(df).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, again)) == sorted(expected)


def test_op10_against_all_pairs(spark, sf_dir, texts):
    found = QUERIES["op10_jaccard"](spark, sf_dir).select("doc_id", "class_id", "n_links").collect()
    expected = plain_classes(sorted(texts.items()))
    assert sorted(map(tuple, found)) == sorted(expected)
    assert any(n for *_, n in expected)


def test_one_of_each(spark, hostile):
    kept = jaccard.one_of_each(hostile)
    assert kept.columns == hostile.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    left = {(1, WORDS), (4, None), (5, ""), (7, HOSTILE[8][1])} | {HOSTILE[i][:2] for i in (6, 7, 9, 10, 11)}
    assert ids == sorted((k is None, k or 0, t or "") for k, t in left)
    assert jaccard.one_of_each(hostile.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """A pair at 0.8 is hardly ever lost by the comparison."""
    least = jaccard.fewest_matches(0.8, 1e-6)
    assert least == sorted(least) and least[-1] < 0.7 * 160
    draw = np.random.default_rng(1).random((100_000, 160)) < 0.8
    matches = draw.cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (matches < np.array(least)).any(axis=1).sum() <= 5


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    root = list(range(26))
    for a, b in links:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    df = spark.createDataFrame(links or [(0, 0)], "u bigint, v bigint")
    found = {r["node"]: r["root"] for r in components(df).collect()}
    used = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: root[x] for x in used}


def plain_nearest(rows, k):
    usable = {
        key: np.array(v, dtype=float) for key, v in rows
        if key is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)
    }
    for q in usable:
        if q % 20 == 0:
            scores = sorted((-float((usable[q] * v).sum()), key) for key, v in usable.items() if key != q)
            yield q, [(key, -s) for s, key in scores[:k]]


def test_forest_of_hostile_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(k, (draw.standard_normal(8) * (1 + k % 5)).tolist()) for k in range(300)]
    rows += [(k, [1.0] * 8) for k in range(300, 340)]  # ties
    rows += [(400, None), (401, [0.0] * 8), (402, [None] * 8), (403, [float("nan")] * 8), (404, [])]
    rows += [(405, [float("inf")] * 8), (None, [1.0] * 8), (406, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("block", F.lit(1))
    vectors = forest.vectors_of(df).cache()
    path = scratch_dir(spark)
    forest.write_index(vectors, path, block=100)
    found = defaultdict(list)
    for r in forest.search(spark, path, vectors.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r["query_id"]]) + 1
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    expected = dict(plain_nearest([r for r in rows if r[1] is None or len(r[1]) == 8], 20))
    assert set(found) == set(expected)
    for q, best in expected.items():  # blocks are small here, so every candidate is looked at
        assert [v for v, _ in found[q]] == [v for v, _ in best]
        assert np.allclose([s for _, s in found[q]], [s for _, s in best], rtol=0, atol=1e-12)


def test_forest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    path = scratch_dir(spark)
    forest.write_index(forest.vectors_of(df), path)
    assert forest.search(spark, path, forest.vectors_of(df)).count() == 0


def test_going_up_finds_the_longest_common_prefix():
    draw = np.random.default_rng(0)
    vectors = draw.standard_normal((500, 16))
    keys, places = forest.build(np.arange(500), vectors)
    lift = np.sqrt(np.maximum((np.linalg.norm(vectors, axis=1) ** 2).max() - (vectors**2).sum(1), 0))
    asked = forest.hash_strings(np.column_stack([vectors, lift]), forest.planes(17))[:5]
    lo, hi = forest.ascend(keys.astype(np.uint64), asked, 700)
    for q in range(5):
        counts = []
        for depth in range(forest.LENGTH + 1):
            shift = forest.LENGTH - depth
            same = [(keys[t].astype(np.uint64) >> np.uint64(shift)) == (np.uint64(asked[q, t]) >> np.uint64(shift)) for t in range(forest.TREES)]
            counts.append(int(np.sum(same)))
        depth = max(d for d, n in enumerate(counts) if n >= 700)
        assert (hi - lo)[:, q].sum() == counts[depth]


def test_recall_of_op5(spark, tmp_path):
    """Vectors without clusters, the hardest case: at least 0.9 of the true neighbours."""
    draw = np.random.default_rng(8)
    vectors = draw.standard_normal((9000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    df.write.parquet(f"{path}/embeddings.parquet")
    exact = np.array(vectors, dtype=np.float32).astype(float)
    found = QUERIES["op5_forest"](spark, path).toPandas()
    hits = 0
    for q, rows in found.groupby("query_id"):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(rows["vec_id"]))
    assert len(found) == 450 * 20 and hits / len(found) >= 0.9


def test_empty_texts_fill_segments_too(spark):
    """100,000 null texts make many segments, and documents among them are found."""
    rows = spark.range(100_000).selectExpr("id as doc_id", "cast(null as string) as text")
    docs = rows.unionByName(spark.createDataFrame([(-1, "one two three four")], "doc_id bigint, text string"))
    path = scratch_dir(spark)
    positions.write_index(docs.coalesce(1), path, segment_words=64_000)
    index = spark.read.parquet(path).filter(F.col("term") == positions.DIRECTORY)
    assert index.count() > 90 and index.agg(F.max(F.size("doc_ids"))).first()[0] <= 1000
    items = spark.createDataFrame([(5, "two three")], "item_id bigint, text string")
    found = positions.search(spark, path, positions.windows(items)).filter("n_hit > 0").collect()
    assert [(r["doc_id"], r["n_hit"], r["labels"]) for r in found] == [(-1, 2, ["5"])]


def test_phrases_longer_than_the_usual_gap(spark):
    words = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, words), (2, f"w89 {words}"), (3, words[:-4])], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, words), (None, words)], "item_id bigint, text string")
    path = scratch_dir(spark)
    positions.write_index(docs, path, gap=100)
    found = positions.search(spark, path, positions.windows(items, 90)).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["labels"], r["unnamed"]) for r in found] == [(90, ["1"], True)] * 2 + [(0, [], False)]


def test_forest_of_repeated_ids(spark):
    """Which of the rows with one id counts does not depend on their order."""
    draw = np.random.default_rng(5)
    rows = [(k % 200, draw.standard_normal(8).tolist()) for k in range(400)]
    seen = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(parts)
        vectors, path = staged(forest.vectors_of(df)), scratch_dir(spark)
        forest.write_index(vectors, path)
        found = forest.search(spark, path, vectors.filter("vec_id % 20 = 0"))
        seen.append(sorted(map(tuple, found.collect())))
    assert seen[0] == seen[1]
    kept = {}
    for key, v in rows:
        kept[key] = min(kept.get(key, v), v)
    expected = dict(plain_nearest(kept.items(), 20))
    assert [(q, v) for q, _, v, _ in seen[0]] == [(q, v) for q in sorted(expected) for v, _ in expected[q]]
