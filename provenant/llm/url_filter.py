"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter. DataFrame functions only.

A listed URL stands in the filter by its canonical form. One hash chooses a block
of 256 bits and another sets two bits in each of its four words, so that a probe
reads one row of the filter. Blocks are built by a combined OR in Spark and sent
to all tasks: at most MAX_BLOCKS of them, whatever the length of the list. A URL
whose block lacks one of its bits is not listed, and its row is not moved again.
Possible hits go on to an exact hash join with the list, which removes the false
positives; a longer list only makes more of them.

Rules are a short tuple held by the plan. Of the rules that fit, the longest
(host and path together) decides, before the list does; of equally long ones,
the one with the longer host.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.exact_dedup import fold_ascii
from provenant.llm.textops import durable

#: 2**20 blocks are 32 MB of bits, about 100 MB as a hash table in each executor; at BITS bits a URL they serve 22 million listed URLs at full sharpness.
BITS, WORDS, MAX_BLOCKS = 12, 4, 1 << 20
#: Fields of a query string that only say where a reader came from: the canonical form leaves them out.
TRACKING = r"(^|&)(utm_[a-z]+|fbclid|gclid|ref)=[^&]*"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and query without tracking fields: the same for http and https, and without port 80 or 443. Null without ://."""
    fields = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _URL, 3), TRACKING, ""), "^&", "")
    made = F.concat(F.regexp_replace(host(url), ":(80|443)$", ""), F.regexp_replace(path(url), "/+$", ""), F.when(fields == "", "").otherwise(F.concat(F.lit("?"), fields)))
    return F.when(url.contains("://"), made)


def ruling(name: Column, where: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits a host and path; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r)):  # the last one stands outermost
        fits = ((name == r.host) | name.endswith("." + r.host)) & where.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """The bits that a key sets in each word of its block."""
    h = F.xxhash64(F.lit(1), key)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(block, w0 .. w3) of the blocks in use, and the number of blocks: a power of two, max_blocks at most. keys: one column named key."""
    blocks = min(max_blocks, 1 << (keys.count() * BITS // (64 * WORDS)).bit_length())
    words = keys.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("key")))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))), blocks


def _judged(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...], url_col: str, listed_col: str, max_blocks: int) -> DataFrame:
    """pages with host, path, rule and verdict, as (row, host, path, rule, verdict)."""
    keys = durable(listed.select(canonical(F.col(f"`{listed_col}`").cast("string")).alias("key")).filter("key IS NOT NULL").distinct())
    filter_, blocks = bloom(keys, max_blocks)
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    ruled = rows.withColumn("by", ruling(F.col("host"), F.col("path"), rules)).select("row", "host", "path", "by.rule", "by.verdict", F.when(F.col("by").isNull(), F.col("key")).alias("key"))
    probed = ruled.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_), "block", "left")
    hit = F.lit(True)
    for k, mask in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(mask) == mask)
    probed = probed.withColumn("hit", F.coalesce(F.col("key").isNotNull() & hit, F.lit(False)))
    out = ["row", "host", "path", "rule"]
    clear = probed.filter(~F.col("hit")).select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    possible = probed.filter("hit").select(*out, "key").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    return clear.unionByName(possible.select(*out, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = (), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rule is the deciding rule's host and path, null where no rule fits; then a
    listed URL is blocked and any other allowed. A null URL, or one without ://,
    has an empty host and path, fits no rule with a host and is never listed.
    Null, unusable and repeated rows of the list are passed over; repeated rows
    of pages are judged each. Other columns are not read. Empty tables give an
    empty result, an empty list blocks nothing.
    """
    judged = _judged(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")), listed, rules, "url", listed_col, max_blocks)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def keep(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = (), url_col: str = "url", listed_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows that are allowed, with all their columns whatever their names."""
    return _judged(pages, listed, rules, url_col, listed_col, max_blocks).filter("verdict = 'allow'").select("row.*")
