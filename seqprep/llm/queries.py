"""One registered query for each operator, over its whole table, and its SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.llm import (
    bestfit, crossentropy, forest, jaccard, langid, merkle, planes, positions, quotes, shards, subwords, trie,
    urls,
)
from seqprep.llm.common import lower_ascii, scratch_dir, staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as byte planes and read back."""
    path = scratch_dir(spark)
    planes.write_planes(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=1
    )
    return planes.read_planes(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    pieces = bestfit.cut_pieces(docs, public_tokenizers.path(TOKENIZER), end_id=0, tokens=2048)
    narrow = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return bestfit.assign(narrow, tokens=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op3_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packed(table(spark, sf_dir, "documents"))


def searched(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with the benchmark items whose ten-word windows it holds."""
    path = scratch_dir(spark)
    positions.write_index(docs, path)
    return positions.search(spark, path, positions.windows(benchmark, size=10))


@query
def op8_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items they come from.

    All items without an id count as one in ``n_items``.
    """
    found = searched(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("labels") + F.col("unnamed").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("labels", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)

SQL["op8_positions"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS k
        FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN win USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates and number of links of every document."""
    found = jaccard.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "n_links")


def held_out() -> Column:
    """Documents that the language classifier does not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of them is held out from training."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter("doc_id is not null").filter(~held_out()))
    return langid.predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; listed are the URLs of three kinds of host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(urls.host_of(F.col("url")).rlike(r"(^|\.)(spam-farm|adult-x|ads-track)\."))
    return urls.judge(pages, listed, RULES)


_HOST = (
    "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
)

SQL["op4_urls"] = f"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\\.', '') <> '' THEN
      regexp_replace(host, '^www\\.', '')
      || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '')
      || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c
  FROM (SELECT *, list_sort(list_filter(
          string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=.*)?$'))) AS q FROM p)),
listed AS (SELECT DISTINCT c FROM c WHERE regexp_matches(host, '(^|\\.)(spam-farm|adult-x|ads-track)\\.')),
rules(verdict, h, t) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, arg_max(h || t, length(h || t)) AS rule,
         arg_max(verdict, length(h || t)) AS verdict
  FROM p, rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, t)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN c IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(c IN (SELECT c FROM listed), false) AS listed
FROM c LEFT JOIN best USING (page_id)"""


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by bytes."""
    found = shards.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, from the whole table."""
    vectors = staged(forest.vectors_of(table(spark, sf_dir, "embeddings")))
    path = scratch_dir(spark)
    forest.write_index(vectors, path)
    return forest.search(spark, path, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query
def op6_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every document under a model of the good ones less that under one of all others."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = crossentropy.with_target(table(spark, sf_dir, "documents"), good)
    return crossentropy.score(docs, crossentropy.train(docs))


def wrapped(text: Column) -> Column:
    """A text in lines of seven words."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"((?:[^ ]+ +){6}[^ ]+) +", "$1\n")


def quoting(messages: DataFrame) -> DataFrame:
    """The conversations as mail: users quote the message before theirs, assistants the one before
    that, and everybody also what stood before the quoted message, one level deeper. In turn the quote
    stands as it was, is wrapped anew, is wrapped anew without its first sentence, or is left out so that
    only the deeper one is there."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    quoted = F.col("turn") - F.when(F.col("role") == "assistant", 2).otherwise(1)
    asked = messages.select("conv_id", "turn", "role", "text", quoted.alias("t1"), (quoted - 1).alias("t2"))
    for n in (1, 2):
        source = texts.select("conv_id", F.col("turn").alias(f"t{n}"), F.col("said").alias(f"q{n}"))
        asked = asked.join(source, ["conv_id", f"t{n}"], "left")
    way, q1 = (F.col("conv_id") + F.col("turn")) % 4, F.col("q1")
    part = F.regexp_replace(F.replace(q1, F.lit("\n"), F.lit(" ")), "^[^.!?]*[.!?] *", "")
    asked = asked.withColumn("q1", F.when(way == 0, q1).when(way == 1, wrapped(q1)).when(way == 2, wrapped(part)))

    def marked(text: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.replace(F.col(text), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))

    parts = [F.coalesce(marked("q2", ">> "), F.lit("")), F.coalesce(marked("q1", "> "), F.lit(""))]
    return asked.select("conv_id", "turn", "role", F.concat(*parts, F.coalesce("text", F.lit(""))).alias("text"))


@query
def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in the order of replies, without the quotes that linked them."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = quotes.linked(staged(quoting(messages)))
    return found.withColumn("reply_to", F.coalesce("reply_to", F.lit(-1).cast("bigint")))


_NORMAL = r"trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((>[ \t]?)+)', '')), '\s+', ' ', 'g'))"
_FLAT = "replace(a.text, chr(10), ' ')"
_WRAP = r"regexp_replace({}, '((?:[^ ]+ +){{6}}[^ ]+) +', '\1' || chr(10), 'g')"
_QUOTED = f"""CASE (m.conv_id + m.turn) % 4 WHEN 0 THEN a.text WHEN 1 THEN {_WRAP.format(_FLAT)}
    WHEN 2 THEN {_WRAP.format(f"regexp_replace({_FLAT}, '^[^.!?]*[.!?] *', '')")} END"""
_ENDS = r"regexp_replace(passage, '([.!?]) |([。！？])', '\1\2' || chr(10), 'g')"

SQL["op2_quotes"] = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, turn - CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS t1
  FROM conversations),
mail AS (
  SELECT m.conv_id, m.turn, m.role,
    coalesce('>> ' || replace(b.text, chr(10), chr(10) || '>> ') || chr(10), '')
    || coalesce('> ' || replace({_QUOTED}, chr(10), chr(10) || '> ') || chr(10), '')
    || coalesce(m.text, '') AS text
  FROM m LEFT JOIN conversations a ON a.conv_id = m.conv_id AND a.turn = m.t1
         LEFT JOIN conversations b ON b.conv_id = m.conv_id AND b.turn = m.t1 - 1),
raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM mail),
said AS (SELECT conv_id, turn, line, place, {_NORMAL} AS said,
  length(regexp_replace(regexp_extract(line, '^[ 	]*((?:>[ 	]?)+)', 1), '[^>]', '', 'g')) AS level
  FROM raw),
starts AS (SELECT *, said <> '' AND coalesce(lag(said) OVER w = '' OR lag(level) OVER w <> level, true) AS begins
  FROM said WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)),
runs AS (SELECT *, sum(begins::int) OVER (PARTITION BY conv_id, turn ORDER BY place) AS run FROM starts),
pas AS (SELECT conv_id, turn, level, run, string_agg(said, ' ' ORDER BY place) AS passage
  FROM runs WHERE said <> '' GROUP BY ALL),
parts AS (
  SELECT conv_id, turn, level, passage, said AS unit, 1 AS line FROM runs JOIN pas USING (conv_id, turn, level, run)
  WHERE said <> ''
  UNION ALL SELECT conv_id, turn, level, passage, passage, 0 FROM pas
  UNION ALL SELECT conv_id, turn, level, passage, trim(unnest(string_split({_ENDS}, chr(10)))), 0 FROM pas),
units AS (SELECT conv_id, turn, level, passage, unit, max(line) AS line FROM parts WHERE unit <> '' GROUP BY ALL),
first AS (SELECT conv_id, unit, min(turn) AS source FROM units WHERE level = 0 GROUP BY ALL),
found AS (SELECT u.*, CASE WHEN source < u.turn THEN source END AS source
  FROM units u LEFT JOIN first USING (conv_id, unit) WHERE level > 0),
links AS (SELECT conv_id, turn, level, passage, sum(line) AS n_lines, count(source) FILTER (line = 1) AS n_lines_linked,
  coalesce(max(source) FILTER (unit = passage), max(source)) AS source FROM found GROUP BY ALL),
shallow AS (SELECT conv_id, turn, min(level) AS level FROM links WHERE source IS NOT NULL GROUP BY ALL),
replies AS (SELECT l.conv_id, l.turn, max(source) FILTER (l.level = s.level) AS reply_to, sum(n_lines) AS n_quoted,
  sum(n_lines_linked) AS n_linked, count(*) AS n_passages, count(source) AS n_found
  FROM links l LEFT JOIN shallow s USING (conv_id, turn) GROUP BY ALL),
told AS (SELECT conv_id, turn, role, text, reply_to, n_quoted, n_linked, n_passages, n_found
  FROM mail LEFT JOIN replies USING (conv_id, turn)),
tree AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM told WHERE reply_to IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, tree.thread, tree.depth + 1
  FROM told t JOIN tree ON t.conv_id = tree.conv_id AND t.reply_to = tree.turn),
own AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY place) AS text
  FROM said WHERE level = 0 GROUP BY ALL)
SELECT conv_id, turn, role, thread, depth, coalesce(reply_to, -1) AS reply_to,
  coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_found, 0)::BIGINT AS n_found,
  coalesce(own.text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position
FROM told JOIN tree USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)"""


CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc_t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
  FROM range(256) r(i)))"""


def crc32_sql(number: str) -> str:
    """Unsigned crc32 of a decimal number, where ``crc_table`` is joined."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    step = "lambda c, b: xor(c // 256, crc_t[xor(c, b) % 256 + 1])"
    return f"xor(list_reduce({codes}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def leaf_of(text: Column) -> Column:
    return merkle.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document; one in five is tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select(
        "source", "doc_id", leaf_of(F.col("text")).alias("leaf"),
        F.when(tampered, leaf_of(lower_ascii(F.col("text")))).alias("claim"),
    )
    path = scratch_dir(spark)
    merkle.write_manifest(rows, path, ["claim"])
    root = F.lit(merkle.root(spark, path))
    found = merkle.proofs(spark, path, ["claim"]).withColumn(
        "folded_root", merkle.folded(F.coalesce("claim", "leaf"), F.col("path"))
    )
    return found.select(
        "doc_id", "leaf", "subroot", root.alias("root"),
        merkle.digest(merkle.proof_text(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def _merkle_sql(levels: int = 8) -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""d AS (SELECT doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN {leaf(lower)} END AS claim FROM documents, crc_table)""",
        """t AS (SELECT doc_id, leaf, claim, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)""",
        "a0 AS (SELECT tree, i, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM t)",
    ]
    for name in "ab":  # the trees of the sources, then the top tree
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT tree, i // 16 AS i, (max(n) + 15) // 16 AS n,
  CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE max(node) END AS node
  FROM {name}{k} GROUP BY tree, i // 16)"""
            )
            parts.append(
                f"""{name}s{k} AS (SELECT x.tree, x.i, max(x.n) > 1 AS real,
  coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
  coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.i // 16 = y.i // 16 GROUP BY x.tree, x.i)"""
            )
        if name == "a":
            parts.append(
                f"b0 AS (SELECT 0 AS tree, tree AS i, node, count(*) OVER () AS n FROM a{levels})"
            )
    parts.append("f0 AS (SELECT *, coalesce(claim, leaf) AS f, '' AS proof FROM t)")
    at = 0
    for name in "ab":
        for k in range(levels):
            key = f"s.tree = f{at}.tree AND s.i = f{at}.i // {16 ** k}" if name == "a" else f"s.i = f{at}.tree // {16 ** k}"
            parts.append(
                f"""f{at + 1} AS (SELECT f{at}.* REPLACE (CASE WHEN real THEN sha256(s.l || f || s.r) ELSE f END AS f,
  CASE WHEN real THEN proof || s.l || s.r ELSE proof END AS proof) FROM f{at} JOIN {name}s{k} s ON {key})"""
            )
            at += 1
    return (
        "WITH " + ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, a{levels}.node AS subroot, b{levels}.node AS root, sha256(proof) AS proof_sha256,
  f AS folded_root, f = b{levels}.node AS verified
FROM f{at} JOIN a{levels} USING (tree), b{levels}"""
    )


SQL["op11_merkle"] = _merkle_sql()


@query
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that borrow the first turns of others."""
    turns = staged(trie.turns_of(table(spark, sf_dir, "conversations")))
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string")) % 6
    return trie.trie(*trie.regrafted(turns, conv - conv % 100, head))


SQL["op12_trie"] = f"""
WITH {CRC_TABLE},
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(md5(
          length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) AS p,
        {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS u
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(u ORDER BY p) AS us FROM m GROUP BY conv_id),
h AS (SELECT conv_id, us, {crc32_sql("conv_id")} % 6 AS h FROM own, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(b.us, [])[1 : h.h], h.us[h.h + 1 :]) AS us
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, us, unnest(range(0, len(us) + 1)) AS depth FROM r),
node AS (SELECT depth, us[1 : depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(us) = depth), '') AS ends
  FROM pre GROUP BY depth, us[1 : depth]),
up AS (SELECT node.*, path[1 : depth - 1] AS parent,
    (n_convs - 1) * CASE WHEN depth > 0 THEN length(path[depth].t) ELSE 0 END AS own_saved FROM node),
child AS (SELECT parent AS path, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
f AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN child USING (path, depth)),
under AS (SELECT path[1 : d] AS path, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own_saved) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN under USING (path, depth) LEFT JOIN f p ON p.depth = f.depth - 1 AND p.path = f.parent AND f.depth > 0"""


@query
def op13_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of them is held out from training."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").filter(~out)
    found = subwords.score(docs, subwords.train(docs, labels))
    return found.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
