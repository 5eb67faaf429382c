"""Text to tokens to ids and back, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.functions.basics import computed_once, ints

# ---- fixed values -------------------------------------------------------------------------
# Whitespace cut from both ends of a line (the Unicode whitespace characters).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A run of digits is one token, every other character but the comma is one token.
TOKEN_PATTERN = "[0-9]+|[^,]"
# Symbols of the vocabularies in id order.
NUMERAL_V1_SYMBOLS = "|=/$?&*-+><[](){};."
NUMERAL_V0_SYMBOLS = "|=/$"
LEGO_SYMBOLS = "abcdefghijklmnopqrstuvwxyz+-1|=?/$:TF"
NUMERAL_IGNORED = ":"  # has id -1
SEPARATORS = "|/="  # stand singly between the numbers of a line
UNKNOWN_TEXT = "<|unk|>"
# Separator clean-up when numeral tokens become text, applied in this order.
NUMERAL_JOINS = [(",|,", "|"), (",/,", "/"), (",=", "="), ("=,", "="), (",:", ":")]
# -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocab:
    """``numbers`` ids for "0".."numbers-1", then one id per symbol, then -1 for ``ignored``."""

    kind: str
    numbers: int
    symbols: str
    ignored: str = ""

    @property
    def size(self) -> int:
        return self.numbers + len(self.symbols) + len(self.ignored)

    @property
    def eos_id(self) -> int:
        """End, begin and padding share one id: the first free one."""
        return self.size

    @property
    def nodes(self) -> int:
        """Ids below this count as nodes."""
        return 26 if self.kind == "lego" else self.numbers

    def symbol_ids(self) -> dict[str, int]:
        ids = {s: self.numbers + i for i, s in enumerate(self.symbols)}
        ids.update({s: -1 for s in self.ignored})
        return ids

    def id_of(self, symbol: str) -> int:
        return self.symbol_ids()[symbol]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The vocabulary as ``(token, id)`` rows."""
        numbers = spark.range(self.numbers).select(
            F.col("id").cast("string").alias("token"), F.col("id").cast("int").alias("id")
        )
        symbols = spark.createDataFrame(list(self.symbol_ids().items()), "token string, id int")
        return numbers.unionAll(symbols)


def vocab_of(kind: str, num_nodes: int = 50) -> Vocab:
    if kind == "numeral-v1":
        return Vocab(kind, num_nodes, NUMERAL_V1_SYMBOLS, NUMERAL_IGNORED)
    if kind == "numeral-v0":
        return Vocab(kind, num_nodes, NUMERAL_V0_SYMBOLS, NUMERAL_IGNORED)
    if kind == "lego":
        return Vocab(kind, 0, LEGO_SYMBOLS)
    raise ValueError(f"unknown vocabulary kind: {kind}")


def vocab_kind_for(dataset_name: str, preference: bool = False) -> str:
    """Choose the vocabulary by dataset name; preference data always uses the small numeral one."""
    if preference:
        return "numeral-v0"
    if "lego" in dataset_name:
        return "lego"
    if "shortest" in dataset_name:
        return "numeral-v1"
    raise ValueError(f"no vocabulary for dataset {dataset_name!r}")


def strip(text: Column) -> Column:
    """Cut whitespace, Unicode spaces included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_parts(text: Column, sep: str) -> Column:
    return F.split(strip(text), re.escape(sep), -1)


def split_prompt_target(df: DataFrame, text: str, sep: str = "=") -> tuple[DataFrame, DataFrame]:
    """Split ``prompt + sep + target`` lines.

    Returns ``(accepted, rejects)``: the first with columns ``prompt`` (which keeps the
    separator) and ``target`` added, the second with ``n_parts`` for every line that does not
    have exactly two parts.
    """
    # Two parts means one separator. Counting it is cheap enough to be done again where the
    # optimiser pushes this filter towards the scan; splitting there would not be. Later filters
    # may be evaluated before this one, so the parts are read in a way that allows for any number.
    bare = F.octet_length(F.replace(F.col(text), F.lit(sep), F.lit("")))
    separators = F.octet_length(F.col(text)) - bare
    parts = split_parts(F.col(text), sep)
    split = df.filter(separators == 1).withColumn("_parts", parts)
    prompt = F.concat(F.get("_parts", 0), F.lit(sep))
    accepted = computed_once(split, prompt=prompt, target=F.get("_parts", 1)).drop("_parts")
    rejects = df.filter(~separators.eqNullSafe(1)).withColumn("n_parts", F.size(parts))
    return accepted, rejects


def prefix_space(text: Column, on: bool = True) -> Column:
    return F.concat(F.lit(" "), text) if on else text


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens without building them: runs of digits plus all other characters."""
    others = F.length(F.translate(text, ",0123456789", ""))
    return others + F.regexp_count(text, F.lit("[0-9]+"))


def unknown_count(text: Column, vocab: Vocab) -> Column:
    """Number of tokens outside the vocabulary, counted by kind of character.

    Only runs of digits are looked at one by one; other characters are counted by deleting them.
    """
    known = "".join(s for s in vocab.symbol_ids() if not s.isdigit())
    deleted = F.translate(text, ",0123456789" + known, "")
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    return F.length(deleted) + F.size(F.filter(runs, lambda r: token_id(r, vocab).isNull()))


def token_id(token: Column, vocab: Vocab) -> Column:
    """The id of one token, null when unknown.

    Single characters are looked up by code point in a constant array; longer digit runs are
    their own id. Both take constant time, whereas a map lookup scans its keys.
    """
    by_code: list[str] = ["null"] * 128
    for number in range(min(vocab.numbers, 10)):
        by_code[ord(str(number))] = str(number)
    for symbol, id_ in vocab.symbol_ids().items():
        by_code[ord(symbol)] = str(id_)
    table = F.expr(f"cast(array({','.join(by_code)}) as array<int>)")
    single = F.try_element_at(table, F.ascii(token) + 1)
    if vocab.numbers <= 10:
        return F.when(F.length(token) == 1, single)
    number = token.try_cast("int")
    canonical = (number < vocab.numbers) & ~token.startswith("0")
    return F.when(F.length(token) == 1, single).when(canonical, number)


def encode_tokens(tokens: Column, vocab: Vocab) -> Column:
    return F.transform(tokens, lambda t: token_id(t, vocab))


def encode(text: Column, vocab: Vocab) -> Column:
    """Text to ``array<int>``; unknown tokens become null.

    Most numeral lines are known numbers with one separator between them. Their separators become
    ids in the text, which is then cut and cast as a whole; others are looked up token by token.
    """
    each = encode_tokens(tokenize(text), vocab)
    separators = [s for s in SEPARATORS if s in vocab.symbols]
    if vocab.numbers not in range(10, 101, 10) or "=" not in separators:
        return each
    number = f"[1-{vocab.numbers // 10 - 1}]?[0-9]" if vocab.numbers > 10 else "[0-9]"
    # Possessive, so that the matcher needs no stack for long lines.
    regular = f"^{number}(?:[,{''.join(separators)}]{number})*+=?\\z"
    told = text
    for symbol in separators:
        told = F.replace(told, F.lit(symbol), F.lit(f",{vocab.id_of(symbol)},"))
    whole = F.split(F.rtrim(told, F.lit(",")), ",").try_cast("array<int>")
    return F.when(F.rlike(text, F.lit(regular)), whole).otherwise(each)


def ids_to_tokens(ids: Column, vocab: Vocab) -> Column:
    """Ids to tokens; unknown ids become null."""
    symbols = F.array(*[F.lit(s) for s in vocab.symbols])

    def name(i: Column) -> Column:
        number = F.when((i >= 0) & (i < vocab.numbers), i.cast("string"))
        symbol = number.when(i >= vocab.numbers, F.try_element_at(symbols, i - vocab.numbers + 1))
        return symbol.when(i == -1, F.lit(vocab.ignored or None).cast("string"))

    return F.transform(ids, name)


def detokenize(tokens: Column, vocab: Vocab) -> Column:
    """Tokens to text. Numeral text gets some, not all, of its commas back."""
    if vocab.kind == "lego":
        return F.array_join(tokens, "", "")
    text = (
        F.array_join(tokens, ",", UNKNOWN_TEXT)
        if vocab.kind == "numeral-v1"
        else F.array_join(tokens, ",")
    )
    for found, put in NUMERAL_JOINS:
        text = F.replace(text, F.lit(found), F.lit(put))
    return text


def decode(ids: Column, vocab: Vocab) -> Column:
    return detokenize(ids_to_tokens(ids, vocab), vocab)


def with_bos(first: Column, second: Column | None = None, *, bos_id: int, add_bos: bool) -> Column:
    """A sequence, or a pair of them, with the begin token before each part."""
    bos = [ints(bos_id)] if add_bos else []
    parts = [*bos, first] + ([*bos, second] if second is not None else [])
    return F.concat(*parts)


def special_mask(first: Column, second: Column | None = None, *, add_bos: bool) -> Column:
    """1 where :func:`with_bos` put a begin token, 0 elsewhere."""
    parts = []
    for part in [first] if second is None else [first, second]:
        if add_bos:
            parts.append(ints(1))
        parts.append(F.array_repeat(F.lit(0), F.size(part)))
    return F.concat(*parts)


def node_set(ids: Column, num_nodes: int) -> Column:
    """Distinct ids below ``num_nodes``, sorted so that a hashed pick is repeatable. -1 passes."""
    return F.sort_array(F.array_distinct(F.filter(ids, lambda i: i < num_nodes)))


def roundtrip_audit(df: DataFrame, text: str, vocab: Vocab) -> DataFrame:
    """Rows whose text does not survive encode and decode."""
    back = decode(encode(F.col(text), vocab), vocab)
    return df.withColumn("decoded", back).filter(~F.col("decoded").eqNullSafe(F.col(text)))


def oov_rate(df: DataFrame, text: str, vocab: Vocab, by: str) -> DataFrame:
    """Unknown tokens per group: ``by, n_tokens, n_unknown, unknown_share``.

    The counts are taken inside each row, so only one small row per group and task is shuffled.
    """
    return (
        df.groupBy(by)
        .agg(
            F.sum(token_count(F.col(text)).cast("bigint")).alias("n_tokens"),
            F.sum(unknown_count(F.col(text), vocab).cast("bigint")).alias("n_unknown"),
        )
        .withColumn("unknown_share", F.col("n_unknown") / F.nullif(F.col("n_tokens"), F.lit(0)))
    )
