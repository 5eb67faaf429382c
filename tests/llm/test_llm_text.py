"""Language, cross-entropy, quotes, URLs and shards."""

import base64
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqprep.llm import crossentropy, langid, quotes, shards, urls
from seqprep.llm.queries import QUERIES, RULES, SQL, held_out

from .conftest import HOSTILE


FINNISH = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki "
    "ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella on oikeus elämään, "
    "vapauteen ja henkilökohtaiseen turvallisuuteen. Ketään ei saa pitää orjana tai orjuutettuna. "
)


def sql_rows(sf_dir, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def same(rows, expected):
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


# ---- language -----------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir, documents):
    rows = QUERIES["op7_langid"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    tested = [r for r in rows if r["held_out"]]
    assert len(rows) == documents.count() and len(tested) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) >= 0.98
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_of_hostile_documents(spark, hostile, documents):
    model = langid.train(documents)
    rows = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.predict(hostile, model).collect()}
    unknown = {k for k, name, _ in rows if name == langid.UNKNOWN}
    assert unknown == {4, 5, 6}
    assert {k for k, name, far in rows if far} >= {4, 5, 6}
    kept = langid.accepted(hostile, model)
    assert kept.columns == hostile.columns
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 3, 8}
    assert langid.predict(hostile.limit(0), model).count() == 0


def test_language_without_training(spark, hostile):
    assert langid.train(hostile.limit(0)) is None
    rows = langid.predict(hostile, None).collect()
    assert len(rows) == len(HOSTILE) and {r["lang_pred"] for r in rows} == {langid.UNKNOWN}
    assert langid.train(hostile).languages == ["en", "fr", "xx"]


def test_sample_is_bounded(spark, documents):
    big = documents.crossJoin(spark.range(5)).select((F.col("doc_id") * 10 + F.col("id")).alias("doc_id"), "lang", "text")
    model = langid.train(big, sample=20, k=3)
    assert len(model.languages) == 4 and len(model.centroids) <= 12


def test_far_texts_are_rejected(documents):
    model = langid.train(documents)
    made = [langid.counts("Щука рак и лебедь однажды взялись везти с поклажей воз " * 5)]
    _, score, far = model.predict(np.stack([c for c, _ in made]), [n for _, n in made])
    assert far[0] and score[0] < 0.5


def test_texts_of_no_language_are_rejected(spark, sf_dir):
    """Gibberish, base64 and a language not learnt, against clean rows that were held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and text is not null")
    rows = docs.select("doc_id", "lang", "text").collect()
    learnt = [r for r in rows if r["doc_id"] % 4]
    clean = [r["text"] for r in rows if not r["doc_id"] % 4 and len(r["text"]) >= 256]
    draw = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    bad = ["".join(draw.choice(letters, 1000)), base64.b64encode(draw.bytes(900)).decode(), FINNISH * 3]
    model = langid.train(spark.createDataFrame(learnt, "doc_id bigint, lang string, text string"))

    def rejected(texts):
        made = [langid.counts(t) for t in texts]
        return model.predict(np.stack([c for c, _ in made]), [n for _, n in made])[2]

    assert rejected(bad).all()
    assert rejected(clean).mean() <= 0.05 and len(clean) > 20


def test_clusters_find_groups():
    draw = np.random.default_rng(2)
    centres = np.eye(3, 20)
    rows = np.concatenate([c + 0.05 * draw.standard_normal((30, 20)) for c in centres])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own = (rows @ langid.cluster(rows, 3).T).argmax(axis=1).reshape(3, 30)
    assert all(len(set(group)) == 1 for group in own.tolist()) and len(set(own[:, 0])) == 3


# ---- cross-entropy ------------------------------------------------------------------------


def plain_losses(documents, targets):
    """Mean loss under both models, with dictionaries and one character at a time."""
    n, order = crossentropy.SYMBOLS, crossentropy.ORDER
    seen = Counter(c for _, t in documents for c in (t or "").lower())
    vocabulary = {c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], ord(x[0])))[: n - 1]}

    def symbols(text):
        return [None] * (order - 1) + [c if c in vocabulary else None for c in text.lower()]

    models = []
    for wanted in (True, False):
        grams = [Counter() for _ in range(order + 1)]
        for key, text in documents:
            if text and (key in targets) == wanted:
                s = symbols(text)
                for i in range(order - 1, len(s)):
                    for k in range(1, order + 1):
                        grams[k][tuple(s[i - k + 1 : i + 1])] += 1
        totals, types = defaultdict(Counter), defaultdict(Counter)
        for k in range(1, order + 1):
            for g, times in grams[k].items():
                totals[k][g[:-1]] += times
                types[k][g[:-1]] += 1
        models.append((grams, totals, types))

    def loss(model, s, i):
        grams, totals, types = model
        p = 1 / n
        for k in range(1, order + 1):
            g = tuple(s[i - k + 1 : i + 1])
            t, o = types[k][g[:-1]], totals[k][g[:-1]]
            if o:
                p = o / (t + o) * grams[k][g] / o + t / (t + o) * p
        return -math.log(p)

    for key, text in documents:
        s = symbols(text or "")
        at = range(order - 1, len(s))
        yield key, [sum(loss(m, s, i) for i in at) / len(at) if len(at) else None for m in models]


def test_losses_against_plain_counting(spark, hostile):
    rows = [(k, t) for k, t, *_ in HOSTILE if k not in (7, None)]
    docs = crossentropy.with_target(
        hostile.filter("doc_id != 7"), spark.createDataFrame([(1,), (3,), (9,), (None,), (1,)], "doc_id bigint")
    )
    found = crossentropy.score(docs, crossentropy.train(docs)).collect()
    expected = list(plain_losses(rows, {1, 3, 9}))
    key = lambda x: (x[0], x[1][0] or 0)
    seen = sorted(((r["doc_id"], [r["loss_target"], r["loss_background"]]) for r in found), key=key)
    for (a, x), (b, y) in zip(seen, sorted(expected, key=key), strict=True):
        assert a == b and (x == y or np.allclose(x, y, atol=1e-4))


SCRIPTS = [
    (1, "山高水長 風月無邊 0123"), (2, "山高水長 花鳥風月 4567"), (3, "мороз и солнце день чудесный"),
    (4, "ещё ты дремлешь друг прелестный"), (5, "".join(map(chr, range(0x4E00, 0x4E80)))), (6, None), (7, "12:30 'x' \0"),
]


@pytest.mark.parametrize("hot, numbered", [(1_000_000, 65_535), (20, 65_535), (1_000_000, 12), (0, 9)])
def test_every_character_is_a_symbol_of_its_own(spark, monkeypatch, hot, numbered):
    """Scripts of many characters; n-grams that are broadcast, joined, or both."""
    monkeypatch.setattr(crossentropy, "HOT", hot)
    monkeypatch.setattr(crossentropy, "NUMBERED", numbered)
    docs = spark.createDataFrame([(k, t, k in (1, 3)) for k, t in SCRIPTS], "doc_id bigint, text string, target boolean")
    found = {r["doc_id"]: r for r in crossentropy.score(docs, crossentropy.train(docs)).collect()}
    for key, expected in plain_losses(SCRIPTS, {1, 3}):
        seen = [found[key]["loss_target"], found[key]["loss_background"]]
        assert seen == expected or np.allclose(seen, expected, rtol=0, atol=1e-6)
    assert found[1]["score"] < 0 < found[2]["score"]


def test_documents_that_the_models_have_not_seen(spark):
    docs = spark.createDataFrame([(k, t, k in (1, 3)) for k, t in SCRIPTS], "doc_id bigint, text string, target boolean")
    models = crossentropy.train(docs)
    new = spark.createDataFrame([(1, "風月 水長 мороз ξ")], "doc_id bigint, text string")
    row = crossentropy.score(new, models).first()
    shown = spark.createDataFrame([(0, 0)], "ctx bigint, last int").limit(0)
    assert crossentropy.unseen(shown, models).count() == 0
    whole = crossentropy.unseen(models.grams[-1].select("ctx", "last"), models).join(
        models.grams[-1].select("ctx", "last", F.col("p_target").alias("p")), ["ctx", "last"]
    )
    assert whole.filter("p != p_target").count() == 0 and whole.count() == models.grams[-1].count()
    assert 0 < row["loss_target"] < math.log(crossentropy.SYMBOLS) + 3


def test_op6_tells_good_from_other(spark, sf_dir, documents):
    rows = QUERIES["op6_crossentropy"](spark, sf_dir).collect()
    assert len(rows) == documents.count()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    mean = lambda x: sum(x) / len(x)
    assert mean([r["score"] for r in rows if r["doc_id"] in good]) < mean(
        [r["score"] for r in rows if r["doc_id"] not in good]
    )


def test_cross_entropy_of_nothing(spark, hostile):
    docs = crossentropy.with_target(hostile.limit(0), hostile.limit(0))
    assert crossentropy.score(docs, crossentropy.train(docs)).count() == 0


# ---- quotes -------------------------------------------------------------------------------

MAIL = [
    (1, 0, "user", "Hello there\nSecond line"),
    (1, 1, "assistant", "> Hello there\nAn answer\n>\n"),
    (1, 2, "user", "A new subject"),
    (1, 3, "assistant", ">> Hello   THERE\n> An answer\nThanks"),
    (1, 4, "user", ">new subject?\n> a new subject\nTo that"),
    (1, 5, "user", "> nobody said this\nStill own"),
    (1, 6, "user", "> Still own\n> To that\nBoth"),
    (1, 6, "user", "> Still own\n> To that\nBoth"),
    (2, 0, "user", None),
    (2, 1, None, "> hello there"),
    (None, 3, "user", "> x"),
    (3, None, "user", "y"),
]


def test_replies_of_hostile_messages(spark):
    df = spark.createDataFrame(MAIL, "conv_id bigint, turn bigint, role string, text string").withColumn(
        "thread", F.lit("clash")
    )
    rows = quotes.linked(df).collect()
    first = [r for r in rows if r["conv_id"] == 1]
    told = {r["turn"]: (r["reply_to"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"]) for r in first}
    assert told == {
        0: (None, 0, 0, 0, 0), 1: (0, 0, 1, 1, 1), 2: (None, 2, 0, 0, 0), 3: (1, 0, 2, 2, 2),
        4: (2, 2, 1, 2, 1), 5: (None, 5, 0, 1, 0), 6: (5, 5, 1, 2, 2),
    }
    assert [r["turn"] for r in sorted(first, key=lambda r: r["position"])] == [0, 1, 3, 2, 4, 5, 6, 6]
    assert sorted(r["position"] for r in first) == list(range(8))
    assert next(r["text"] for r in first if r["turn"] == 3) == "Thanks"
    assert len(rows) == len(MAIL)
    assert quotes.linked(df.limit(0)).count() == 0


REQUOTED = [
    (1, 0, "The first point is long\nand wrapped here. A second point! 第一句。第二句。\n\nAnother paragraph."),
    (1, 1, "Something between. With its own end."),
    (1, 2, "> The first point is long and\n> wrapped here. A second\n> point! 第一句。第二句。\nWrapped anew"),
    (1, 3, "> A second\n> point!\nOne sentence, wrapped anew"),
    (1, 4, "> 第二句。\nA wide one"),
    (1, 5, ">>> Something between. With\n>>> its own end.\nDeeper, wrapped anew"),
    (1, 6, "> said elsewhere\n>> Wrapped\n>> ANEW\nFirst level unknown"),
    (1, 7, "> Something between. Not with this end.\nPart of one, part unknown"),
    (1, 8, "> Another paragraph. Something between.\nPut together: the latest"),
    (1, 9, "> The first point\nHalf a line is no passage"),
    (1, 10, "> Something between. With its own end.\n>\n> Another paragraph.\nTwo passages"),
    (2, 0, "> Another paragraph.\nOf another conversation"),
]


def test_quotes_wrapped_anew_in_part_and_deeper(spark):
    rows = quotes.linked(spark.createDataFrame(REQUOTED, "conv_id int, turn int, text string").selectExpr("*", "'r' as role"))
    told = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_passages"], r["n_found"]) for r in rows.collect()}
    assert told == {
        (1, 0): (None, 0, 0), (1, 1): (None, 0, 0), (1, 2): (0, 1, 1), (1, 3): (0, 1, 1), (1, 4): (0, 1, 1),
        (1, 5): (1, 1, 1), (1, 6): (2, 2, 1), (1, 7): (1, 1, 1), (1, 8): (1, 1, 1), (1, 9): (None, 1, 0),
        (1, 10): (1, 2, 2), (2, 0): (None, 1, 0),
    }


def test_op2_matches_sql(spark, sf_dir):
    names, expected = sql_rows(sf_dir, "op2_quotes", "conversations")
    rows = QUERIES["op2_quotes"](spark, sf_dir).select(*names).collect()
    same(rows, expected)
    assert max(r["depth"] for r in rows) >= 2


# ---- URLs ---------------------------------------------------------------------------------

ADDRESSES = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org", "http://notexample.org/es/",
    "http://www.bad.net/a/", "https://bad.net/a.html?utm_source=f#top", "http://bad.net/a?x=1&ref=q", "http://BAD.net/A",
    "http://bad.net/b", "ftp://x.com/fr/?", "a://b.com/de/://c", "http://org/", "http://example.org/en/12", "http://bad.net\n/a",
]


def plain_verdict(url, listed):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "block" if url in listed else "allow"))
    return host, path, rule, verdict


def test_hostile_addresses(spark):
    rows = [(n, u) for n, u in enumerate(ADDRESSES)] + [(0, None), (None, "http://bad.net/a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("http://bad.net/a",), (None,), ("",), ("http://bad.net/a",)], "url string")
    found = urls.judge(pages, listed, RULES).collect()
    hits = {"http://www.bad.net/a/", "https://bad.net/a.html?utm_source=f#top", "http://bad.net/a"}
    same(
        [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found],
        [(n, *plain_verdict(u, hits)) for n, u in rows],
    )
    none = urls.judge(pages, listed.limit(0), RULES).filter("listed").count()
    assert none == 0 and urls.judge(pages.limit(0), listed, RULES).count() == 0


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(4000).select(F.concat(F.lit("in/"), "id").alias("c"))
    others = spark.range(40_000).select(F.concat(F.lit("out/"), "id").alias("c"))
    blocks = 4000 * urls.BITS // 512
    bloom = urls.blocked_bloom(listed, blocks, "c").cache()
    assert urls.possible_hits(listed, bloom, blocks, "c").count() == 4000
    assert urls.possible_hits(others, bloom, blocks, "c").count() < 0.01 * 40_000


def test_op4_matches_sql(spark, sf_dir):
    names, expected = sql_rows(sf_dir, "op4_urls", "pages")
    rows = QUERIES["op4_urls"](spark, sf_dir).select(*names).collect()
    same(rows, expected)
    assert {r["verdict"] for r in rows} == {"allow", "block"} and any(r["listed"] for r in rows)


# ---- shards -------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(1, 5))
def test_differencing_gives_every_item_a_part(sizes, k):
    part = shards.karmarkar_karp(sizes, k)
    assert len(part) == len(sizes) and all(0 <= p < k for p in part)
    sums = np.bincount(part, weights=sizes, minlength=k) if sizes else np.zeros(k)
    assert sums.max() - sums.min() <= max(sizes, default=0)


def test_differencing_is_tight():
    sizes = np.random.default_rng(4).integers(1, 10_000, 3000).tolist()
    sums = np.bincount(shards.karmarkar_karp(sizes, 16), weights=sizes)
    assert sums.max() - sums.min() <= 5
    assert np.bincount(shards.karmarkar_karp([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4]).tolist() in ([14, 16], [16, 14])


def check_shards(rows, documents, n, spread):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in documents
    )
    slots, groups, sums = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["size"], r["text_crc32"]].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    assert set(slots) <= set(range(n)) and (spread is None or max(sums.values()) - min(sums.values()) <= spread)


def test_shards_of_hostile_documents(spark, hostile, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_ROWS", 2)
    check_shards(shards.shard_by_bytes(hostile, 3).collect(), [(k, t) for k, t, *_ in HOSTILE], 3, None)
    assert shards.shard_by_bytes(hostile.limit(0), 3).count() == 0


def test_a_group_of_a_third_leaves_the_other_shards_even(spark):
    rows = [(k, "hot " * 50) for k in range(300)] + [(k, f"text {k} " * 20) for k in range(300, 900)]
    found = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    check_shards(found, rows, 4, None)
    sums = Counter()
    for r in found:
        sums[r["shard"]] += r["size"]
    small = sorted(sums.values())[:3]
    assert small[-1] - small[0] <= 0.02 * small[-1]


def test_op9(spark, sf_dir, texts):
    rows = QUERIES["op9_shards"](spark, sf_dir).collect()
    total = sum(len(t.encode()) + 1 for t in texts.values())
    check_shards(rows, list(texts.items()), 16, 0.05 * total / 16)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def plain_columns(text):
    """Hashed 1- to 3-byte n-grams of a text, by loops."""
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    marked, low = b" " + data + b" ", (1 << 32) - 1
    found = {}
    for n, base in ((1, 0), (2, 1 << 20), (3, 1 << 28)):
        for i in range(len(marked) - n + 1):
            gram = 0
            for b in marked[i : i + n]:
                gram = (gram * 257 + b) & low
            column = ((gram + base) * 2654435761 & low) >> 20
            found[column] = found.get(column, 0) + 1
    return found


def test_language_equals_plain_nearest_centroid(spark, sf_dir, documents, texts):
    """Document frequencies from plain counts of the training rows; predictions by plain cosines."""
    from math import log, log1p, sqrt

    learnt = documents.filter("doc_id is not null").filter(~held_out())
    model = langid.train(learnt)
    counted = {k: plain_columns(t) for k, t in texts.items() if t}
    trained = {r["doc_id"] for r in learnt.filter("lang is not null").select("doc_id").collect()}
    trained = [k for k in trained if k in counted and langid.has_letter(texts[k])]
    within = {}
    for k in trained:
        for c in counted[k]:
            within[c] = within.get(c, 0) + 1
    idf = [log((1 + len(trained)) / (1 + within.get(c, 0))) + 1 for c in range(langid.WIDTH)]
    assert np.allclose(model.idf, idf)
    centroids = [[(c, float(v)) for c, v in enumerate(row) if v] for row in model.centroids]
    assert all(abs(sum(v * v for _, v in row) - 1) < 1e-5 for row in centroids)
    for r in QUERIES["op7_langid"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        if not langid.has_letter(text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        vector = {c: log1p(n) * idf[c] for c, n in counted[r["doc_id"]].items()}
        norm = sqrt(sum(v * v for v in vector.values()))
        near = [sum(v * vector.get(c, 0.0) for c, v in row) / norm for row in centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert r["score"] == pytest.approx(near[best], abs=1e-5)
        assert r["lang_pred"] == model.languages[model.owner[best]]


def test_language_training_is_bounded(spark):
    """Only the languages with most rows are learnt; copies and rows of one id meet once."""
    rows = [(n % 3 or None, f"l{n % 40}" if n % 2 else "big", f"some words number {n % 60}") for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = langid.train(df, most=5, sample=10, k=2)
    assert len(model.languages) == 5 and "big" in model.languages
    again = langid.train(df.repartition(5), most=5, sample=10, k=2)
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.radius, again.radius)
