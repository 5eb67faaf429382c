"""Merkle manifest and prefix trie against plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from seqprep.llm import merkle, trie
from seqprep.llm.common import scratch_dir
from seqprep.llm.queries import leaf_of


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree from the leaves to its last node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def plain_path(levels, i):
    sides = []
    for level in levels[:-1]:
        run = i // 16 * 16
        sides.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return sides


def plain_leaf(row):
    told = [None if v is None else str(v) for v in row]
    return h("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in told))


def plain_manifest(rows):
    """``(doc_id, leaf) -> path`` lists and the root, of ``(source, doc_id, leaf)`` rows."""
    sources = defaultdict(list)
    for source, doc_id, leaf in rows:
        sources[source].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(sources[s])):
            path = plain_path(trees[s], i) + plain_path(top, k)
            found.append((doc_id, leaf, trees[s][-1][0], tuple(path)))
    return found, top[-1][0]


def shown(df):
    return [(r.doc_id, r.leaf, r.subroot, tuple((s.left, s.right) for s in r.path)) for r in df.collect()]


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 2], [300, 5], [1] * 40 + [4200]])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = [(f"s{k}" if k else None, n % 4000 if n % 7 else None, h(f"{k} {n}")) for k, m in enumerate(sizes) for n in range(m)]
    random.Random(3).shuffle(rows)
    path = scratch_dir(spark)
    merkle.write_manifest(spark.createDataFrame(rows, "source string, doc_id bigint, leaf string"), path)
    expected, root = plain_manifest(rows)
    assert merkle.root(spark, path) == root
    assert Counter(shown(merkle.proofs(spark, path))) == Counter(expected)


def test_only_every_second_level_is_written(spark):
    rows = [("s", n, h(str(n))) for n in range(300)]
    path = scratch_dir(spark)
    merkle.write_manifest(spark.createDataFrame(rows, "source string, doc_id bigint, leaf string"), path)
    held = [spark.read.parquet(f"{path}/sources/level-{k}").count() for k in (0, 2, 4)]
    assert held == [300, 2, 1]
    assert not spark._jvm.java.io.File(f"{path}/sources/level-1").exists()


def test_proofs_fold_to_the_root_and_catch_changes(spark):
    rows = [(f"s{n % 3}", n, h(str(n))) for n in range(500)]
    path = scratch_dir(spark)
    merkle.write_manifest(spark.createDataFrame(rows, "source string, doc_id bigint, leaf string"), path)
    root = merkle.root(spark, path)
    bad = F.when(F.col("doc_id") % 5 == 0, merkle.digest(F.col("leaf"))).otherwise(F.col("leaf"))
    found = merkle.proofs(spark, path).select("doc_id", merkle.folded(bad, F.col("path")).alias("root")).collect()
    assert len(found) == 500 and all((r.root == root) == (r.doc_id % 5 != 0) for r in found)


def test_manifest_of_hostile_documents(spark, hostile):
    df = hostile.withColumn("leaf", leaf_of(F.col("text")))
    path = scratch_dir(spark)
    merkle.write_manifest(df, path)
    rows = [(r.source, r.doc_id, plain_leaf([r.doc_id, r.source, r.lang, r.n_chars, r.text])) for r in df.collect()]
    expected, root = plain_manifest(rows)
    assert merkle.root(spark, path) == root
    assert Counter(shown(merkle.proofs(spark, path))) == Counter(expected)


def test_manifest_of_an_empty_table(spark, hostile):
    path = scratch_dir(spark)
    merkle.write_manifest(hostile.limit(0).withColumn("leaf", leaf_of(F.col("text"))), path)
    assert merkle.root(spark, path) is None and merkle.proofs(spark, path).count() == 0


def plain_trie(rows):
    """All nodes of ``(conv_id, turn, role, text)`` rows, after borrowing as the query does."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    from hashlib import md5

    told = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))
        told[c] = [t[2:] for t in turns]
    members = defaultdict(list)
    for c in told:
        n = zlib.crc32(str(c).encode()) % 6
        made = told.get(c - c % 100, [])[:n] + told[c][n:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append((c, len(made) == d))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [under(c) for c in children[node]]
        return max(1, sum(b[0] for b in below)), own + sum(b[1] for b in below)

    found = []
    for node, held in members.items():
        leaves, saved = under(node)
        ends = ",".join(str(c) for c, last in sorted(held) if last)
        parent = min(members[node[:-1]])[0] if node else None
        found.append((min(held)[0], len(node), parent, len(held), len(children[node]), leaves, saved, h(ends)))
    return found


def spark_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("depth", "node", "place", "head", "n", "_piece"):
        df = df.withColumn(name, F.lit(1))
    turns = trie.turns_of(df)
    conv = F.col("conv_id")
    made = trie.trie(*trie.regrafted(turns, conv - conv % 100, F.crc32(conv.cast("string")) % 6))
    return [tuple(r) for r in made.collect()]


def conversations(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.choice([1, 2, 3, 3, 9])):
            role = draw.choice(["user", "assistant", None])
            text = draw.choice(["", None, "é😀", "a", "ab", "shared words"])
            rows.append((c * 7 % 250, draw.choice([t, t, None]), role, text))
    rows += [(None, 1, "user", "nobody's")] * 3 + [(777, n, "user", f"turn {n % 5}") for n in range(60)]
    return rows + [(778, n, "user", f"turn {n % 5}") for n in range(57)] + [(779, None, None, None)] * 4


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_trie(spark, seed):
    rows = conversations(seed)
    assert Counter(spark_trie(spark, rows)) == Counter(plain_trie(rows))


def test_trie_in_small_pieces_and_without_broadcasts(spark, monkeypatch):
    """Long conversations in many pieces, heavy nodes apart from others, long lists of ids in chunks."""
    monkeypatch.setattr(trie, "PIECE", 8)
    monkeypatch.setattr(trie, "BROADCAST_NODES", -1)
    monkeypatch.setattr(trie, "FEW_HEAVY", 3)
    rows = conversations(3, 40) + [(c, 0, "user", "same") for c in range(1000, 1300)]
    assert Counter(spark_trie(spark, rows)) == Counter(plain_trie(rows))


def test_ends_over_several_chunks():
    import pyarrow as pa

    ids = sorted(random.Random(5).sample(range(10**9), 3000))
    batch = pa.RecordBatch.from_pydict({"node": [b"a"] * 3000 + [b"b"], "conv_id": ids + [4]})
    cut = list(trie._chunks(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert [c[0] for c in cut] == [b"a", b"b"]
    small = pa.RecordBatch.from_pydict({"node": [b"a", b"a", b"b"], "ids": [",".join(map(str, ids[:10])), ",".join(map(str, ids[10:])), "4"]})
    assert list(trie._digests(iter([small]))) == [(b"a", h(",".join(map(str, ids)))), (b"b", h("4"))]


def test_trie_of_an_empty_table(spark):
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "user", "x")]) == []
