"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a filter of blocks of eight 64-bit words. A URL's hash picks one block and one bit
in each word, so a probe touches one row of the filter. URLs whose eight bits are set are possible
hits; an exact join on the canonical URL removes the false ones. Everything is column expressions.

The filter has ``BITS`` bits a listed URL. Up to ``BROADCAST_BLOCKS`` blocks (a checked 6 MB) it is
broadcast; a larger one is joined by block number, which spreads evenly because it is a hash. URLs
that occur often are joined once: probes and the exact join run over distinct canonical URLs.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is
never listed; null or empty list entries list nothing; repeated pages are judged each by itself;
an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import lower_ascii, needed

BITS = 16
WORDS = 8
BROADCAST_BLOCKS = 100_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the spellings of an address; null where there is no host.

    The scheme, a leading "www.", the fragment, tracking parameters (utm_*, ref), empty queries,
    a trailing ".html" and trailing slashes go.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(
            F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|ref)(=.*)?$") & (p != ""))
        ),
        "&",
    )
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), "/+$", "")
    full = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", full)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest rule (verdict, host, path) that fits; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, where, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(under)
        told = F.struct(F.lit(where + under).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, told).otherwise(chosen)
    return chosen


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(1)), F.lit(n_blocks))


def _bits(url: Column) -> list[Column]:
    """One bit in each of the eight words, six bits of a second hash a word."""
    h = F.xxhash64(url, F.lit(2))
    return [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.shiftright(h, 6 * i).bitwiseAND(F.lit(63))).cast("int"))
        for i in range(WORDS)
    ]


def blocked_bloom(listed: DataFrame, n_blocks: int, url: str = "url") -> DataFrame:
    """``block, w0 .. w7`` of the blocks that hold a URL."""
    bits = listed.select(_block(F.col(url), n_blocks).alias("block"), *[
        b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(url)))
    ])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(urls: DataFrame, bloom: DataFrame, n_blocks: int, url: str = "url") -> DataFrame:
    """The rows of ``urls`` whose bits are all set in their block."""
    blocks = F.broadcast(bloom) if n_blocks <= BROADCAST_BLOCKS else bloom
    probed = urls.withColumn("block", _block(F.col(url), n_blocks)).join(blocks, "block")
    for i, b in enumerate(_bits(F.col(url))):
        probed = probed.filter(F.col(f"w{i}").bitwiseAND(b) != 0)
    return probed.select(*urls.columns)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    page_id: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page.

    A rule's verdict goes before the list's; a listed URL is blocked, any other allowed.
    """
    entries = (
        needed(listed, url=listed_url).select(canonical(F.col("url")).alias("c")).filter("c is not null").distinct()
    )
    n_blocks = max(1, -(-entries.count() * BITS // (64 * WORDS)))
    asked = needed(pages, page_id=page_id, url=url).withColumn("c", canonical(F.col("url")))
    bloom = blocked_bloom(entries, n_blocks, "c")
    maybe = possible_hits(asked.select("c").filter("c is not null").distinct(), bloom, n_blocks, "c")
    hits = maybe.join(entries, "c", "left_semi").withColumn("hit", F.lit(True))
    told = best_rule(F.col("host"), F.col("path"), rules)
    return (
        asked.join(hits, "c", "left")
        .select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
            F.coalesce("hit", F.lit(False)).alias("listed"),
        )
        .withColumn("told", told)
        .select(
            "page_id", "host", "path", F.col("told.rule").alias("rule"),
            F.coalesce(
                F.col("told.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
            "listed",
        )
    )
