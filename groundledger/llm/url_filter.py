"""URL filter in DataFrame expressions only: rules by host and path, then a list of canonical URLs.

The list is turned into a blocked Bloom filter: a row per block of 512 bits, eight words, and every canonical URL sets
eight bits of one block, one per word. URLs that the filter passes are possible hits; an exact hash join with the list
removes the false ones. The filter is about 16 bits per listed URL and is broadcast only below a counted bound.

A rule fits its host and all subdomains of it where the path begins with the rule's; the longest rule wins and decides.
Without a rule a listed URL is blocked and any other allowed. A null url, or one without ``://``, has an empty host and
path, no rule and no canonical form, and is allowed. Null entries of the list are ignored, repeated ones count once.
Repeated pages are judged alike; empty tables give empty results, an empty list hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

WORDS = 8
#: Rows of the filter (72 bytes each) or of the list (a URL each) that may be broadcast.
SMALL_BLOCKS, SMALL_LIST = 500_000, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query parameters in order without ``utm_`` ones; no scheme
    and no fragment. Null where the host is empty."""
    host, path = F.regexp_replace(host_of(url), "^www\\.", ""), F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _bits(key: Column, blocks: Column | int) -> tuple[Column, list[Column]]:
    """Block of a key and a mask per word. The hashes of block and bits are independent."""
    n = blocks if isinstance(blocks, Column) else F.lit(blocks)
    h = F.xxhash64(key, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), n.cast("long")), masks


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, w0 .. w7``."""
    block, masks = _bits(F.col(key), blocks)
    rows = listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """Rows whose key the filter of ``listed`` passes: all that are listed and a few that are not."""
    blocks = max(1, -(-listed.count() * 16 // 512))
    filter_ = bloom(listed, listed_key, blocks)
    filter_ = filter_.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    if blocks <= SMALL_BLOCKS:
        filter_ = F.broadcast(filter_)
    block, masks = _bits(F.col(key), blocks)
    hit = block == F.col("_block")
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) != 0)
    return rows.join(filter_, hit, "left_semi")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(host, path, verdict)`` that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", page_id: str = "page_id",
          listed_url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, listed``."""
    keys = settle(listed.select(canonical(F.col(listed_url)).alias("_listed")).where(F.col("_listed").isNotNull()).distinct())
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    asked = rows.select(canonical(F.col("url")).alias("_key")).where(F.col("_key").isNotNull())
    hits = possible_hits(asked, "_key", keys, "_listed").distinct()
    exact = settle(hits.join(keys, F.col("_key") == F.col("_listed"), "left_semi"))
    if exact.count() <= SMALL_LIST:
        exact = F.broadcast(exact)
    rows = rows.withColumn("_own", canonical(F.col("url"))).join(exact, F.col("_own") == F.col("_key"), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    found = F.col("_key").isNotNull()
    return rows.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(
        verdict, F.when(found, "block").otherwise("allow")).alias("verdict"), found.alias("listed"))
