"""The SQL counterpart of every registered query, for DuckDB over the same tables.

Written from the operator definitions, not from the Spark code: vocabularies are maps here,
packing is a recursive query, and scores are joins and group-bys over exploded rows.
"""

from __future__ import annotations

# Spelled out here, not taken from the engine that these queries check.
NUMERAL_V1_SYMBOLS = "|=/$?&*-+><[](){};."
NUMERAL_V0_SYMBOLS = "|=/$"
LEGO_SYMBOLS = "abcdefghijklmnopqrstuvwxyz+-1|=?/$:TF"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SEED = 42

# ---- views --------------------------------------------------------------------------------

STAR = """
lines AS (
  SELECT l_orderkey + n // 12 * 1099511627776 AS id, list(l_partkey % 50 ORDER BY n) AS p,
         list(l_suppkey % 50 ORDER BY n) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                     ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n
        FROM lineitem)
  GROUP BY l_orderkey, n // 12),
paths AS (
  SELECT id, p, list_concat([p[1]], q[2:]) AS w0,
         list_concat([p[1]], list_reverse(q[2:])) AS w1
  FROM lines),
edge_rows AS (
  SELECT DISTINCT id, unnest(list_concat(
    list_transform(range(1, len(p)), lambda i: concat(p[i], ',', p[i + 1])),
    list_transform(range(1, len(w0)), lambda i: concat(w0[i], ',', w0[i + 1])))) AS edge
  FROM paths),
edge_text AS (
  SELECT id, string_agg(edge, '|' ORDER BY md5(concat(id, '|', edge))) AS edges
  FROM edge_rows GROUP BY id),
star AS (
  SELECT id, concat(coalesce(edges, ''), '/', p[1], ',', p[len(p)], '=', array_to_string(p, ',')) AS text,
         len(p) AS len_target,
         [array_to_string(w0, ','), array_to_string(w1, ',')] AS wrong_path
  FROM paths LEFT JOIN edge_text USING (id))"""

SHORTEST = STAR + """,
shortest AS (
  SELECT id, split_part(text, '=', 1) AS query, split_part(text, '=', 2) AS target,
         replace(split_part(text, '/', 1), '|', ',') AS steps,
         string_split(split_part(text, '/', 1), '|') AS trace
  FROM star)"""


def _lego(joiner: str) -> str:
    return f"""
part AS (SELECT vec_id * 8 + c AS id, embedding[c * 8 + 1 : c * 8 + 8] AS e
         FROM embeddings, range(8) t(c)),
chain AS (
  SELECT id, i,
         chr(cast(97 + (id + 5 * i) % 26 AS int)) AS v,
         chr(cast(97 + (id + 5 * (i - 1)) % 26 AS int)) AS u,
         e[i + 1] >= 0 AS pos,
         len(list_filter(e[1 : i + 1], lambda x: x < 0)) % 2 = 0 AS pos_all
  FROM part, range(8) r(i)),
clause AS (
  SELECT *, concat(v, '=', CASE WHEN pos THEN '+' ELSE '-' END, u) AS c,
         CASE WHEN pos_all THEN '+1' ELSE '-1' END AS r
  FROM chain),
lego AS (
  SELECT id,
    concat(string_agg(c, '|' ORDER BY md5(concat(id, '|', c))) FILTER (i > 0), '/',
           min(v) FILTER (i = 0), '=', min(r) FILTER (i = 0), ',', min(v) FILTER (i = 7), '=?',
           string_agg(concat(c, '=', r), '{joiner}' ORDER BY i) FILTER (i > 0)) AS symbol_text,
    string_agg(concat(c, '=', r), '{joiner}' ORDER BY i) FILTER (i > 0) AS target_steps,
    min(r) FILTER (i = 7) AS target_direct,
    string_agg(v, ',' ORDER BY i) AS target_path,
    concat(string_agg(concat(c, '=', r), '{joiner}' ORDER BY i) FILTER (i > 0), '?',
           CASE WHEN id % 2 = 0 THEN 'T' ELSE 'F' END) AS target_verify
  FROM clause GROUP BY id)"""


LEGO = _lego(",")

LOGITS = """
logits AS (
  SELECT vec_id // 10 AS seq, vec_id % 10 AS pos, cast(embedding AS double[]) AS v,
         CASE WHEN vec_id % 10 < 4 THEN -1 ELSE label END AS label
  FROM embeddings),
best AS (
  SELECT *, list_position(v, list_max(v)) - 1 AS pred FROM logits),
shifted AS (
  SELECT a.seq, a.pos, a.v, a.pred, b.label, cast(a.pred = b.label AS int) AS correct
  FROM best a JOIN best b ON a.seq = b.seq AND b.pos = a.pos + 1)"""

# ---- expressions --------------------------------------------------------------------------


def _map(entries: list[tuple[str, int]]) -> str:
    keys = ", ".join("'" + t.replace("'", "''") + "'" for t, _ in entries)
    return f"map([{keys}], [{', '.join(str(i) for _, i in entries)}])"


def _entries(numbers: int, symbols: str, ignored: str) -> list[tuple[str, int]]:
    named = [(str(i), i) for i in range(numbers)]
    named += [(s, numbers + i) for i, s in enumerate(symbols)]
    return named + [(s, -1) for s in ignored]


ENTRIES = {
    "v1": _entries(50, NUMERAL_V1_SYMBOLS, ":"),
    "v0": _entries(50, NUMERAL_V0_SYMBOLS, ":"),
    "lego": _entries(0, LEGO_SYMBOLS, ""),
}


def toks(text: str) -> str:
    return f"regexp_extract_all({text}, '[0-9]+|[^,]')"


def enc(text: str, vocab: str = "v1") -> str:
    return f"list_transform({toks(text)}, lambda t: {_map(ENTRIES[vocab])}[t])"


def words(ids: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({ids}, "
        "lambda wt: coalesce(cast(wt AS varchar), '_')), ' '), '')"
    )


def ones(ids: str, value: int = 1) -> str:
    return f"list_transform({ids}, lambda ot: {value})"


def reps(value: str, times: str) -> str:
    return f"list_transform(range(greatest({times}, 0)), lambda rt: {value})"


def cat(*lists: str) -> str:
    out = lists[0]
    for other in lists[1:]:
        out = f"list_concat({out}, {other})"
    return out


def digest(salt: str, pos: str | None = None, row: str = "id") -> str:
    tail = f", '|', {pos}" if pos else ""
    return f"md5(concat('{SEED}|', {row}, '|{salt}'{tail}))"


def num(salt: str, pos: str | None = None) -> str:
    return f"cast(concat('0x', substr({digest(salt, pos)}, 1, 8)) AS bigint)"


def uni(salt: str, pos: str | None = None) -> str:
    return f"({num(salt, pos)} / 4294967296.0::double)"


def pick(nodes: str, salt: str, pos: str | None = None) -> str:
    return f"{nodes}[{num(salt, pos)} % len({nodes}) + 1]"


def shuffled(array: str, salt: str) -> str:
    """Zero-based positions in the order of their digests."""
    keys = (
        f"list_transform(range(len({array})), lambda si: "
        f"concat({digest(salt, 'si')}, '|', si))"
    )
    return f"list_transform(list_sort({keys}), lambda sk: cast(split_part(sk, '|', 2) AS int))"


def strip(text: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim({text}, {chars})"


def nodes(ids: str, limit: int = 50) -> str:
    return f"list_sort(list_distinct(list_filter({ids}, lambda nt: nt < {limit})))"


def split_sql(text: str = "text", sep: str = "=") -> str:
    return f"string_split({strip(text)}, '{sep}')"


# ---- path-finding examples ----------------------------------------------------------------


def encoded(vocab: str = "v1", reverse: bool = False) -> str:
    target = "x[2]"
    if reverse:
        target = "array_to_string(list_reverse(string_split(x[2], ',')), ',')"
    return (
        STAR
        + f""",
halves AS (SELECT id, {split_sql()} AS x, wrong_path FROM star),
e0 AS (
  SELECT id, {enc("x[1] || '='", vocab)} AS p, {enc(target, vocab)} AS t,
         list_transform(wrong_path, lambda w: {enc("w", vocab)}) AS w
  FROM halves WHERE len(x) = 2),
e AS (SELECT *, {nodes("p")} AS n, p[1:len(p) - 1] AS h FROM e0)"""
    )


def train(
    body: str, vocab: str = "v1", reverse: bool = False, eos: bool = True
) -> str:
    """``body`` selects id, prompt, given, lab from e."""
    end = ["[70]"] if eos else []
    return f"""WITH {encoded(vocab, reverse)},
made AS ({body}),
joined AS (
  SELECT id, {cat("prompt", "given", *end)} AS ids, {cat(ones("prompt", -1), "lab", *end)} AS lab
  FROM made)
SELECT id, {words("ids")} AS input_ids, {words(ones("ids"))} AS attention_mask,
       {words("lab")} AS labels
FROM joined"""


def validation(body: str, vocab: str = "v1", reverse: bool = False, padded: bool = True) -> str:
    """``body`` selects id, prompt, tgt from e; targets are padded to the longest of all."""
    longest = "(SELECT max(len_target) FROM star)"
    target = cat("tgt", reps("70", f"{longest} - len(tgt)"), "[70]") if padded else "tgt"
    return f"""WITH {encoded(vocab, reverse)},
made AS ({body})
SELECT id, {words("prompt")} AS input_ids, {words(ones("prompt"))} AS attention_mask,
       {words(target)} AS targets
FROM made"""


PLAIN = "SELECT id, p AS prompt, t AS given, t AS lab FROM e"
PLAIN_VAL = "SELECT id, p AS prompt, t AS tgt FROM e"
TEACHERLESS = (
    "SELECT id, p AS prompt, {blank} AS given, t AS lab FROM e".format(
        blank=cat("[t[1]]", reps("53", "len(t) - 1"))
    )
)
NOISYGUIDE = f"""
SELECT id, p AS prompt, t AS lab,
       CASE WHEN {uni("gate")} < 0.5
            THEN list_transform(t, lambda a, i: CASE WHEN i BETWEEN 2 AND len(t) - 1
                                                     THEN {pick("n", "node", "(i - 1)")} ELSE a END)
            ELSE t END AS given
FROM e"""
NOISYTARGET = f"""
SELECT id, p AS prompt, nt AS given, nt AS lab FROM (
  SELECT id, p,
         CASE WHEN len(t) >= 4 AND {uni("gate")} < 0.5
              THEN {cat(f"t[1:1 + {num('pos')} % greatest(len(t) - 3, 1)]",
                        f"[{pick('n', 'node')}]",
                        f"t[3 + {num('pos')} % greatest(len(t) - 3, 1):]")}
              ELSE t END AS nt
  FROM e)"""
SHORT_V1 = """
SELECT id, CASE WHEN {full} THEN p ELSE list_concat(h, [55]) END AS prompt,
       CASE WHEN {full} THEN t ELSE [coalesce(t[len(t) - 1], t[len(t)])] END AS tgt
FROM e"""
MIX_V1 = SHORT_V1.format(full=f"{uni('gate')} > 0.4")
MIX_V1_VAL = SHORT_V1.format(full=f"{uni('gate')} >= 0.4")
MIX_V0 = f"""
SELECT id, CASE WHEN f THEN p ELSE {cat("h", "[51]", reps("53", "place"))} END AS prompt,
       CASE WHEN f THEN t ELSE [t[place + 1]] END AS tgt
FROM (SELECT *, len(t) < 4 OR {uni("gate")} < 0.4 AS f, 2 + {num("pos")} % greatest(len(t) - 3, 1) AS place FROM e)"""


def as_train(validation_body: str) -> str:
    return f"SELECT id, prompt, tgt AS given, tgt AS lab FROM ({validation_body})"


def improving(keep: str) -> str:
    return f"""
SELECT id, {cat("p", "noisy", "[59]")} AS prompt, better AS tgt FROM (
  SELECT id, p,
    list_transform(t, lambda a, i: CASE WHEN list_contains(c, i - 1)
      THEN {pick("nd", "node", "(i - 1)")} ELSE a END) AS noisy,
    list_transform(t, lambda a, i: CASE WHEN NOT list_contains(c, i - 1) THEN 68
      {keep} ELSE 53 END) AS better
  FROM (SELECT *, list_concat(n, [53]) AS nd,
               ({shuffled("t", "shuffle")})[1:{num("count")} % (len(t) + 1)] AS c
        FROM e))"""


IMPROVING = improving(f"WHEN {uni('keep', '(i - 1)')} < 0.5 THEN a")
IMPROVING_VAL = improving("WHEN true THEN a")


def marked(noisy: str, chosen: str, possible: str = "true") -> str:
    told = (
        "flatten(list_transform(range(1, len(t) + 1), lambda k: "
        "[noisy[k], CASE WHEN list_contains(c, k - 1) THEN 57 ELSE 58 END]))"
    )
    return f"""
SELECT id, {cat("p", "noisy", "[59]")} AS prompt, {cat(told, "[59]", "t")} AS tgt FROM (
  SELECT *, list_transform(t, lambda a, i: CASE WHEN list_contains(c, i - 1)
                                           THEN {noisy} ELSE a END) AS noisy
  FROM (SELECT *, {chosen} AS c FROM e WHERE {possible}))"""


ERROR = marked(
    "w[1][i]",
    f"list_filter({shuffled('t', 'shuffle')}, lambda f: f >= 1)"
    f"[1:CASE WHEN len(t) >= 2 THEN {num('count')} % (len(t) - 1) ELSE 0 END]",
)
ERROR_VAL = marked(
    pick("list_filter(n, lambda o: o <> a)", "node", "(i - 1)"),
    f"({shuffled('t', 'shuffle')})[1:cast(floor(0.4 * len(t)) AS int)]",
    "len(t) >= 3 AND (len(n) > 1 OR (len(n) = 1 AND NOT list_contains(t, n[1])))",
)
STEP_EVAL = f"""
SELECT id, h AS prompt, {cat("[60]", "tried", "t", "[59]", "t")} AS tgt FROM (
  SELECT *, coalesce(flatten(list_transform(({shuffled("w", "shuffle")})
                [1:{num("count")} % (len(w) + 1)], lambda j: list_concat(w[j + 1], [57]))),
                []) AS tried
  FROM e)"""
STEP_EVAL_VAL = f"""
SELECT id, {cat("h", "[60]", "s[1:2]")} AS prompt, {cat("s[3:]", "[59]", "t")} AS tgt
FROM (SELECT *, {cat("w[1]", "[57]", "t")} AS s FROM e)"""

EXAMPLES = {
    "ex_teacherforcing": train(PLAIN),
    "ex_reverse": train(PLAIN, reverse=True),
    "ex_teacherless": train(TEACHERLESS),
    "ex_noisyguide": train(NOISYGUIDE),
    "ex_noisytarget": train(NOISYTARGET),
    "ex_mixtask_v1": train(as_train(MIX_V1)),
    "ex_mixtask_v1_val": validation(MIX_V1_VAL),
    "ex_mixtask_v0": train(as_train(MIX_V0), "v0", eos=False),
    "ex_mixtask_v0_val": validation(MIX_V0, "v0", padded=False),
    "ex_fit_prefix": train(
        f"SELECT id, p[1:0] AS prompt, {cat('p', 't')} AS given, {cat('p', 't')} AS lab FROM e"
    ),
    "ex_improving": train(as_train(IMPROVING)),
    "ex_improving_val": validation(IMPROVING_VAL),
    "ex_error_detection": train(as_train(ERROR)),
    "ex_error_detection_val": validation(ERROR_VAL),
    "ex_step_eval": train(as_train(STEP_EVAL)),
    "ex_step_eval_val": validation(STEP_EVAL_VAL),
    "ex_reverse_val": validation(PLAIN_VAL, reverse=True),
    "ex_validation_v1": validation(PLAIN_VAL),
    "ex_validation_v0": validation(PLAIN_VAL, "v0", padded=False),
    "ex_generation": validation(PLAIN_VAL, "v0", padded=False),
    "ex_teacherforcing_v0": train(PLAIN, "v0", eos=False),
    "ex_teacherless_v0": train(TEACHERLESS, "v0", eos=False),
    "ex_noisyguide_v0": train(NOISYGUIDE, "v0", eos=False),
    "ex_noisytarget_v0": train(NOISYTARGET, "v0", eos=False),
    "stream_equals_batch": train(PLAIN),
}

# ---- lego and shortest-path examples ------------------------------------------------------


def joined(ctes: str, prompt: str, given: str, label: str, extra: str = "") -> str:
    """``ctes`` ends with e(id, ...): put prompt and target in one sequence."""
    return f"""WITH {ctes}
SELECT id, {words(cat(prompt, given))} AS input_ids,
       {words(ones(cat(prompt, given)))} AS attention_mask,
       {words(cat(ones(prompt, -1), label))} AS labels{extra}
FROM e"""


def lego_encoded(prompt: str, target: str, joiner: str = ",") -> str:
    return (
        _lego(joiner)
        + f""",
halves AS (SELECT *, {split_sql("symbol_text", "?")} AS x FROM lego),
e AS (SELECT id, {enc(prompt, "lego")} AS p, {enc(target, "lego")} AS t FROM halves
      WHERE len(x) = 2)"""
    )


ASK = "x[1] || '?'"


def lego_noise(node: str) -> str:
    return f"""CASE WHEN {uni("gate")} < 0.5
  THEN list_transform(t, lambda a, i: CASE WHEN i BETWEEN 2 AND len(t) - 1
                                      THEN {node} ELSE a END) ELSE t END"""


def lego_noisy(task: str, column: str, node: str) -> str:
    return joined(lego_encoded(ASK, column), "p", lego_noise(node), "t", f", '{task}' AS task")


LEGO_NODES = pick(nodes("p", 26), "node", "(i - 1)")
SIGNS = pick("[27, 26]", "node", "(i - 1)")
LEGO_EXTRACT_TARGET = (
    "array_to_string(list_concat([substr(string_split(x[1], '/')[2], 3, 1)], "
    "list_transform(string_split(x[2], ':'), lambda s: s[-2:-2])), ',')"
)
CLOSING = "'-' || array_to_string(list_reverse(string_split(target, ',')), ',') || '>=' || target"


def shortest(query: str, generation: str, fill: str = "0") -> str:
    return (
        SHORTEST
        + f""",
e AS (SELECT id, {cat("[70]", enc(query), reps("70", fill))} AS q,
             {cat(enc(generation), "[70]")} AS g FROM shortest)"""
    )


PAUSE = (
    "array_to_string(list_transform(trace, lambda s: split_part(s, ',', 1) || '($)'), ',') || "
    + CLOSING
)
CHAINS = {
    "lego_steps": joined(lego_encoded(ASK, "target_steps"), "p", "t", "t"),
    "lego_direct": joined(lego_encoded(ASK, "target_direct"), "p", "t", "t"),
    "lego_path": joined(lego_encoded(ASK, "target_path"), "p", "t", "t"),
    "lego_verify": joined(
        lego_encoded(
            "x[1] || '?' || split_part(target_verify, '?', 1) || '?'",
            "split_part(target_verify, '?', 2)",
        ),
        "p", "t", "t",
    ),
    "lego_noisy": "SELECT * FROM (" + lego_noisy("path", "target_path", LEGO_NODES)
    + ") UNION ALL SELECT * FROM (" + lego_noisy("steps", "target_steps", SIGNS) + ")",
    "lego_examples": f"""WITH {lego_encoded(ASK, "target_path")}
SELECT id, {words("p")} AS input_ids, {words(ones("p"))} AS attention_mask,
       {words("t")} AS targets FROM e""",
    "lego_extract": joined(
        lego_encoded(ASK, LEGO_EXTRACT_TARGET, ":"), "p", lego_noise(LEGO_NODES), "t"
    ),
    "lego_split": f"""WITH {LEGO}, halves AS (SELECT id, {split_sql("symbol_text", "?")} AS x FROM lego)
SELECT id, x[1] || '?' AS prompt, x[2] AS target FROM halves WHERE len(x) = 2""",
    "sp_teacherforcing": joined(shortest("query || '='", "target"), "q", "g", "g"),
    "sp_step_eval": joined(shortest("query || '<'", "steps || " + CLOSING), "q", "g", "g"),
    "sp_pause": joined(shortest("query || '<'", PAUSE), "q", "g", "g"),
    "sp_aug_padding": joined(
        shortest("query || '='", "target", f"{num('fill')} % 513"), "q", "g", "g"
    ),
    "sp_validation": f"""WITH {shortest("query || '<'", "steps || " + CLOSING)}
SELECT id, {words("q")} AS input_ids, {words(ones("q"))} AS attention_mask,
       {words(cat("g[1:50]", reps("70", "50 - len(g)")))} AS targets FROM e""",
}

# ---- sources, order, text -----------------------------------------------------------------

STAR_SPLIT = """SELECT id, text, len_target, CASE WHEN row_number() OVER (ORDER BY id)
  <= floor(count(*) OVER () * {pct} / 100.0 + 0.5) THEN 'validation' ELSE 'train' END AS split,
  array_to_string(wrong_path, ';') AS wrong FROM star"""
DOC_SPLIT = """SELECT doc_id, n_chars, CASE WHEN row_number() OVER (ORDER BY doc_id)
  <= floor(count(*) OVER () * 5 / 100.0 + 0.5) THEN 'validation' ELSE 'train' END AS split
  FROM documents"""
HALVES = f"halves AS (SELECT id, {split_sql()} AS x, wrong_path, text FROM star)"


def token_join(ids: str, entries: list[tuple[str, int]]) -> str:
    """Ids back to a list of tokens, unknown ones as null."""
    return f"list_transform({ids}, lambda di: {_id_map(entries)}[di])"


def _id_map(entries: list[tuple[str, int]]) -> str:
    values = ", ".join("'" + t + "'" for t, _ in entries)
    return f"map([{', '.join(str(i) for _, i in entries)}], [{values}])"


def numeral_text(tokens: str) -> str:
    text = (
        f"coalesce(array_to_string(list_transform({tokens}, "
        "lambda dt: coalesce(dt, '<|unk|>')), ','), '')"
    )
    for found, put in [(",|,", "|"), (",/,", "/"), (",=", "="), ("=,", "="), (",:", ":")]:
        text = f"replace({text}, '{found}', '{put}')"
    return text


def vocab_use(kind: str, ctes: str, source: str, text: str) -> str:
    rows = ", ".join("('" + t + f"', {i})" for t, i in ENTRIES[kind])
    return f"""WITH {ctes}vocab(token, id) AS (VALUES {rows}),
used AS (SELECT token, count(*) AS n FROM (SELECT unnest({toks(text)}) AS token FROM {source})
         GROUP BY token)
SELECT token, cast(id AS bigint) AS id, coalesce(n, 0) AS n_used
FROM vocab LEFT JOIN used USING (token)"""


PAIR = f"{HALVES}, e AS (SELECT id, {enc(ASK.replace('?', '='))} AS p, {enc('x[2]')} AS t FROM halves)"
TEXTS = {
    "load_csv": f"""WITH {STAR} SELECT id, text, len_target, split
FROM ({STAR_SPLIT.format(pct=5)})""",
    "load_json": f"""WITH {STAR} SELECT id, text, len_target, wrong, split
FROM ({STAR_SPLIT.format(pct=10)})""",
    "load_dir": f"""WITH {STAR} SELECT id, text, len_target, split
FROM ({STAR_SPLIT.format(pct=5)})""",
    "load_text": f"WITH {STAR} SELECT text || chr(10) AS text FROM star",
    "row_index": """SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_idx
FROM documents""",
    "head_split": DOC_SPLIT,
    "cap_rows": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "sample_rows": f"""WITH {STAR} SELECT id, text FROM star
ORDER BY md5(concat('{SEED}|', id)), id LIMIT 3""",
    "sample_decoded": f"""WITH {STAR}
SELECT id, {numeral_text(toks("split_part(text, '=', 1) || '='"))} AS prompt,
  {numeral_text(toks("split_part(text, '=', 2)"))} AS target
FROM star ORDER BY md5(concat('{SEED}|', id)), id LIMIT 3""",
    "split_counts": f"""SELECT split, count(*) AS n_rows,
  CASE WHEN split = 'train' THEN least(500, count(*)) ELSE count(*) END AS n_kept
FROM ({DOC_SPLIT}) GROUP BY split""",
    "split_prompt_target": f"""WITH {STAR}, {HALVES}
SELECT id, x[1] || '=' AS prompt, x[2] AS target FROM halves WHERE len(x) = 2""",
    "split_rejects": f"""SELECT doc_id, len({split_sql()}) AS n_parts FROM documents
WHERE len({split_sql()}) <> 2""",
    "tokenize": f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, chr(1))) AS tokens_md5,
  t[1] AS first_token, t[len(t)] AS last_token
FROM (SELECT doc_id, {toks("text")} AS t FROM documents)""",
    "token_counts": f"SELECT doc_id, len({toks('text')}) AS n_tokens FROM documents",
    "vocab_numeral_v1": vocab_use("v1", "", "documents", "text"),
    "vocab_numeral_v0": vocab_use("v0", STAR + ", ", "star", "text"),
    "vocab_lego": vocab_use("lego", LEGO + ", ", "lego", "symbol_text"),
    "encode_ids": f"WITH {STAR} SELECT id, {words(enc('text'))} AS ids FROM star",
    "oov_rate": f"""WITH vocab(token) AS (VALUES {", ".join("('" + t + "')" for t, _ in ENTRIES["v1"])}),
used AS (SELECT source, unnest({toks("text")}) AS token FROM documents)
SELECT source, count(*) AS n_tokens, count(*) FILTER (vocab.token IS NULL) AS n_unknown,
  round(count(*) FILTER (vocab.token IS NULL) / count(*), 6) AS unknown_share
FROM used LEFT JOIN vocab ON used.token = vocab.token GROUP BY source""",
    "decode_tokens": f"""WITH {STAR}
SELECT id, {words(token_join(enc("text"), ENTRIES["v1"]))} AS tokens FROM star""",
    "detokenize_numeral": f"""SELECT doc_id,
  {numeral_text(token_join(enc("text"), ENTRIES["v1"]))} AS decoded FROM documents""",
    "detokenize_lego": f"""WITH {LEGO} SELECT id,
  array_to_string({token_join(enc("symbol_text", "lego"), ENTRIES["lego"])}, '') AS decoded
FROM lego""",
    "roundtrip_audit": f"""WITH {LEGO}, back AS (SELECT id, symbol_text,
  {numeral_text(token_join(enc("symbol_text"), ENTRIES["v1"]))} AS decoded FROM lego)
SELECT id, decoded FROM back WHERE decoded <> symbol_text""",
    "with_bos": f"""WITH {STAR}, {PAIR} SELECT id, {words(cat("[70]", "p"))} AS single,
  {words(cat("[70]", "p", "[70]", "t"))} AS pair, {words(cat("p", "t"))} AS bare FROM e""",
    "special_mask": f"""WITH {STAR}, {PAIR}
SELECT id, {words(cat("[1]", ones("p", 0)))} AS single,
  {words(cat("[1]", ones("p", 0), "[1]", ones("t", 0)))} AS pair,
  {words(cat(ones("p", 0), ones("t", 0)))} AS bare FROM e""",
    "node_set": f"SELECT doc_id, {words(nodes(enc('text')))} AS nodes FROM documents",
    "prefix_space": f"""WITH {STAR} SELECT id, {words(enc("' ' || text"))} AS ids FROM star""",
    "preference_pairs": f"""WITH {STAR}, {HALVES}
SELECT id, text, x[1] || '=' AS prompt, x[2] AS chosen, wrong_path[1] AS rejected FROM halves
WHERE len(x) = 2""",
    "preference_distinct": f"""WITH {STAR}, {HALVES}
SELECT id, x[1] || '=' AS prompt, x[2] AS chosen, wrong_path[1] AS rejected FROM halves
WHERE len(x) = 2 AND x[2] <> wrong_path[1]""",
    "max_target_length": f"""WITH {STAR}
SELECT max(len_target) AS max_target_length FROM star""",
    "preference_max_length": f"""WITH {STAR}, {HALVES}
SELECT (SELECT len({toks(ASK.replace("?", "="))}) FROM halves ORDER BY id LIMIT 1)
  + (SELECT max(len_target) FROM star) AS max_length""",
}

# ---- packing and padding ------------------------------------------------------------------


def packed(ctes: str, source: str, key: str, length: str, block: int) -> str:
    """Rows with their batch and chunk, one recursion step per place in the batch."""
    return f"""WITH RECURSIVE {ctes}
placed AS (SELECT *, {length} AS length, (row_number() OVER (ORDER BY {key}) - 1) // 1000 AS batch_id,
           (row_number() OVER (ORDER BY {key}) - 1) % 1000 AS place FROM {source}),
fold AS (
  SELECT batch_id, place, CASE WHEN length <= {block} THEN 0 ELSE 1 END AS chunk, length AS used
  FROM placed WHERE place = 0
  UNION ALL
  SELECT p.batch_id, p.place,
         CASE WHEN f.used + p.length <= {block} THEN f.chunk ELSE f.chunk + 1 END,
         CASE WHEN f.used + p.length <= {block} THEN f.used + p.length ELSE p.length END
  FROM fold f JOIN placed p ON p.batch_id = f.batch_id AND p.place = f.place + 1)"""


CORPUS_PACK = packed(
    f"corpus AS (SELECT doc_id, len({toks('text')}) AS n_tokens FROM documents),",
    "corpus", "doc_id", "n_tokens", 4096,
)
STAR_PACK = packed(
    encoded() + f", made AS (SELECT id, {cat('p', 't', '[70]')} AS ids, "
    f"{cat(ones('p', -1), 't', '[70]')} AS lab FROM e),",
    "made", "id", "len(ids)", 256,
)
CHUNKS = f"""{STAR_PACK},
chunks AS (
  SELECT batch_id, chunk, count(*) AS n_rows, flatten(list(ids ORDER BY place)) AS ids,
         flatten(list(lab ORDER BY place)) AS lab
  FROM placed JOIN fold USING (batch_id, place) GROUP BY batch_id, chunk
  UNION ALL
  SELECT batch_id, 0, 0, [], [] FROM fold WHERE place = 0 AND chunk = 1)"""
PACKED = f"""{CHUNKS}
SELECT batch_id, cast(chunk AS bigint) AS chunk, n_rows, {words("ids")} AS input_ids,
       {words(ones("ids"))} AS attention_mask, {words("lab")} AS labels FROM chunks"""


def padded(length: str, side: str) -> str:
    def fill(array: str, value: str) -> str:
        filler = reps(value, f"{length} - len(ids)")
        return words(cat(filler, array) if side == "left" else cat(array, filler))

    return f"""WITH {encoded()},
made AS (SELECT id, {cat("p", "t", "[70]")} AS ids, {cat(ones("p", -1), "t", "[70]")} AS lab FROM e)
SELECT id, {fill("ids", "70")} AS input_ids, {fill(ones("ids"), "0")} AS attention_mask,
       {fill("lab", "-1")} AS labels FROM made"""


BATCHES = f"""WITH {encoded("v0")},
b AS (SELECT id, p, t, (row_number() OVER (ORDER BY id) - 1) // 256 AS batch_id FROM e)"""
SHAPES = {
    "pack_assign": f"""{CORPUS_PACK}
SELECT doc_id, length, batch_id, cast(chunk AS bigint) AS chunk
FROM placed JOIN fold USING (batch_id, place)""",
    "pack_chunks": PACKED,
    "stream_pack": PACKED,
    "pack_fill": f"""{CHUNKS}
SELECT count(*) AS n_chunks, cast(sum(len(ids)) AS bigint) AS n_tokens,
       round(sum(len(ids)) / count(*) / 256, 6) AS mean_fill FROM chunks""",
    "pad_left": padded("72", "left"),
    "pad_right": padded("72", "right"),
    "pad_multiple": padded("cast(ceil(len(ids) / 8) * 8 AS int)", "right"),
    "batch_pad": f"""{BATCHES},
m AS (SELECT batch_id, max(len(p)) AS n FROM b GROUP BY batch_id)
SELECT id, batch_id, {words(cat(reps("55", "n - len(p)"), "p"))} AS input_ids,
  {words(cat(reps("0", "n - len(p)"), ones("p")))} AS attention_mask, {words("t")} AS targets
FROM b JOIN m USING (batch_id)""",
    "ragged_batches": f"""{BATCHES},
s AS (SELECT batch_id, 'input_ids' AS "column", len(p) AS n FROM b
      UNION ALL SELECT batch_id, 'targets', len(t) FROM b)
SELECT batch_id, "column", min(n) AS min_len, max(n) AS max_len FROM s
GROUP BY batch_id, "column" HAVING min(n) < max(n)""",
}

# ---- scores -------------------------------------------------------------------------------

PREDS = (
    STAR
    + f""",
truth AS (SELECT id, {cat(enc("split_part(text, '=', 2)"), reps("70", "13 - len_target"))} AS labels
          FROM star),
preds AS (
  SELECT id, labels, list_transform(labels, lambda a, i:
    CASE WHEN {uni("flip", "(i - 1)")} < 0.125 THEN {num("token", "(i - 1)")} % 50
         ELSE a END) AS preds
  FROM truth),
cells AS (
  SELECT id, pos, pred, label, cast(label <> 70 AS int) AS mask,
         cast(label <> 70 AND pred = label AS int) AS correct
  FROM (SELECT id, unnest(range(len(labels))) AS pos, unnest(preds) AS pred,
               unnest(labels) AS label FROM preds))"""
)
ROW_OK = "SELECT id, sum(correct) = sum(mask) AS ok FROM cells GROUP BY id"
POS_ACC = "SELECT pos, sum(correct) / (sum(mask) + 1e-9) AS a FROM cells GROUP BY pos"
SOFTMAX = """sm AS (
  SELECT seq, pos, label, pred, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM best)"""
NLL = """nll AS (
  SELECT list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))
         - v[label + 1] AS n FROM shifted WHERE label <> -1)"""
SCORES = {
    "argmax": f"WITH {LOGITS} SELECT seq, pos, cast(pred AS bigint) AS pred FROM best",
    "correct_mask": f"""WITH {PREDS} SELECT id, pos, cast(pred AS bigint) AS pred,
  cast(label AS bigint) AS label, cast(mask AS bigint) AS mask, cast(correct AS bigint) AS correct
FROM cells""",
    "seq_acc": f"""WITH {PREDS}
SELECT 'seq_acc' AS metric, round(avg(cast(ok AS double)), 6) AS value FROM ({ROW_OK})""",
    "token_acc": f"WITH {PREDS} SELECT pos, round(a, 6) AS token_acc FROM ({POS_ACC})",
    "eval_metrics": f"""WITH {PREDS}
SELECT 'seq_acc' AS metric, round(avg(cast(ok AS double)), 6) AS value FROM ({ROW_OK})
UNION ALL SELECT concat('token_acc_', pos), round(a, 6) FROM ({POS_ACC})""",
    "shift_pairs": f"WITH {LOGITS} SELECT seq, pos, cast(label AS bigint) AS label FROM shifted",
    "train_seq_acc": f"""WITH {LOGITS} SELECT 'train_seq_acc' AS metric,
  round(avg(cast(ok AS double)), 6) AS value
FROM (SELECT seq, sum(correct) = count(*) FILTER (label <> -1) AS ok FROM shifted GROUP BY seq)""",
    "column_acc": f"""WITH {LOGITS}
SELECT pos, round(avg(correct), 6) AS column_acc FROM shifted GROUP BY pos""",
    "kth_token_acc": f"""WITH {LOGITS},
k AS (SELECT *, cast(sum(cast(label <> -1 AS int)) OVER (PARTITION BY seq ORDER BY pos) AS bigint) AS k
      FROM shifted)
SELECT k, round(avg(correct), 6) AS kth_acc FROM k WHERE label <> -1 GROUP BY k""",
    "masked_nll": f"WITH {LOGITS}, {NLL} SELECT count(*) AS n_tokens, round(avg(n), 6) AS loss FROM nll",
    "perplexity": f"""WITH {LOGITS}, {NLL}
SELECT count(*) AS n_tokens, round(exp(avg(n)), 6) AS perplexity FROM nll""",
    "softmax": f"""WITH {LOGITS}, {SOFTMAX}
SELECT seq, pos, i - 1 AS token, round(ex[i] / list_sum(ex), 6) AS prob
FROM sm, range(1, 65) r(i)""",
    "token_prob": f"""WITH {LOGITS}, {SOFTMAX}
SELECT seq, pos, cast(label AS bigint) AS label,
  CASE WHEN label >= 0 THEN round(ex[label + 1] / list_sum(ex), 6) ELSE -1.0::double END AS label_prob,
  round(ex[pred + 1] / list_sum(ex), 6) AS pred_prob FROM sm""",
    "topk_tokens": f"""WITH {LOGITS}, {SOFTMAX},
first AS (SELECT seq, min(pos) AS pos FROM logits WHERE label <> -1 GROUP BY seq),
r AS (SELECT seq, i - 1 AS token, ex[i] / list_sum(ex) AS prob,
             row_number() OVER (PARTITION BY seq ORDER BY ex[i] DESC, i) - 1 AS rank
      FROM sm JOIN first USING (seq, pos), range(1, 65) t(i))
SELECT seq, rank, token, round(prob, 6) AS prob FROM r WHERE rank < 3""",
    "generation_rows": f"""WITH {LOGITS}, {SOFTMAX},
a AS (SELECT *, cast(pos - 4 AS bigint) AS place FROM sm WHERE pos >= 4),
r AS (SELECT seq, i - 1 AS token, ex[i] / list_sum(ex) AS prob,
             row_number() OVER (PARTITION BY seq ORDER BY ex[i] DESC, i) - 1 AS place
      FROM a, range(1, 65) t(i) WHERE pos = 4)
SELECT seq, 'token' AS kind, place, cast(pred AS bigint) AS token, round(ex[pred + 1] / list_sum(ex), 6) AS prob FROM a
UNION ALL SELECT seq, 'best', place, token, round(prob, 6) FROM r WHERE place < 3
UNION ALL SELECT seq, 'label', place, label, round(ex[label + 1] / list_sum(ex), 6) FROM a WHERE pos = 4""",
    "generation_metrics": f"""WITH {LOGITS}, a AS (SELECT * FROM best WHERE pos >= 4)
SELECT 'seq_acc' AS metric, round(avg(ok), 6) AS value
FROM (SELECT cast(bool_and(label = 0 OR pred = label) AS double) AS ok FROM a GROUP BY seq)
UNION ALL SELECT concat('token_acc_', pos - 4),
  round(sum(cast(label <> 0 AND pred = label AS int)) / (sum(cast(label <> 0 AS int)) + 1e-9), 6)
FROM a GROUP BY pos""",
    "union_batches": f"""WITH {PREDS}
SELECT id, cast(sum(correct) AS bigint) AS n_correct FROM cells GROUP BY id""",
    "tail_slice": f"WITH {PREDS} SELECT id, {words('preds')} AS generated FROM preds",
    "metric_flush": """WITH ml AS (
  SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'eval' END AS split,
         event_type AS key, value, event_type = 'purchase' AS flush FROM events),
n AS (SELECT *, cast(coalesce(sum(cast(flush AS int)) OVER (PARTITION BY split ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS flush_id,
        sum(cast(flush AS int)) OVER (PARTITION BY split) AS flushes FROM ml)
SELECT split, flush_id, key, round(avg(value), 6) AS value FROM n
WHERE NOT flush AND flush_id < flushes GROUP BY split, flush_id, key""",
}


# Places in a file written in the order of ids are the ids' ranks.
RANKED = f"""WITH {encoded()},
made AS (SELECT id, {cat("p", "t", "[70]")} AS ids, {cat(ones("p", -1), "t", "[70]")} AS lab FROM e),
ranked AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place,
                  floor(count(*) OVER () * 5 / 100.0 + 0.5) AS held FROM star)"""
FILES = {
    "load_text_split": f"""{RANKED}
SELECT place AS id, {words("ids")} AS input_ids, {words(ones("ids"))} AS attention_mask,
       {words("lab")} AS labels, CASE WHEN place < held THEN 'validation' ELSE 'train' END AS split
FROM made JOIN ranked USING (id)""",
    "load_csv_plain": f"""WITH {STAR}
SELECT row_number() OVER (ORDER BY id) - 1 AS id, text, len_target, split
FROM ({STAR_SPLIT.format(pct=5)})""",
    "stream_job": f"""SELECT * FROM ({train(PLAIN)}) WHERE id IN (
  SELECT id FROM (WITH {STAR} SELECT id FROM ({STAR_SPLIT.format(pct=5)}) WHERE split = 'train'))""",
    "job_counts": f"""WITH {STAR} SELECT split, count(*) AS n_rows,
  CASE WHEN split = 'train' THEN least(1000, count(*)) ELSE count(*) END AS n_kept
FROM ({STAR_SPLIT.format(pct=10)}) GROUP BY split""",
    "rejects_error_detection": f"""WITH {encoded()}
SELECT id, CASE WHEN id % 7 < 2 THEN 'parts' ELSE 'target' END AS reason FROM e
WHERE id % 7 < 2 OR NOT (len(t) >= 3 AND (len(n) > 1 OR (len(n) = 1 AND NOT list_contains(t, n[1]))))""",
    "ex_malformed": f"SELECT * FROM ({validation(ERROR_VAL)}) WHERE id % 7 >= 2",
    "rejects_step_eval": f"""WITH {STAR}
SELECT id, 'wrong_path' AS reason FROM star WHERE len_target % 2 = 0""",
}
SAME = {
    "row_index_ranges": TEXTS["row_index"],
    "pack_assign_ranges": SHAPES["pack_assign"],
    "batch_pad_ranges": SHAPES["batch_pad"],
    "metric_flush_ranges": SCORES["metric_flush"],
    "stream_lego": CHAINS["lego_path"],
    "stream_shortest": CHAINS["sp_step_eval"],
}


def sql() -> dict[str, str]:
    return {**TEXTS, **EXAMPLES, **CHAINS, **SHAPES, **SCORES, **FILES, **SAME}
