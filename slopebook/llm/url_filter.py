"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact join.

Everything is DataFrame expressions.  The filter is a table of 64-bit blocks:
a URL's hash names its block and four bits in it; a block is the OR of its
URLs' bits.  The table has at most ``BLOCKS`` rows (a fixed parameter, 1 MB),
so broadcasting it is bounded whatever the list's size; a longer list only
lets more URLs through to the exact join, which removes every false positive.

``canonical``: scheme dropped, host lower-cased without a leading ``www.`` and
default port, path without trailing slashes, query and fragment dropped.

Edge cases: null urls and urls without ``://`` have empty host and path, are in
no list and are allowed by the method; repeated rows are judged alike; an
empty list blocks nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the Bloom filter: the broadcast has at most this many rows of 16 bytes.
BLOCKS = 65_536
BITS = 4

#: (verdict, rule): host and path prefix; the longest rule that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"\Awww\.", ""), r":(80|443)\z", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+\z", "")))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: the host or a domain above it, and a prefix of the path."""
    fits = []
    for _verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        on_host = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(on_host & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*fits)


def bloom_block(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BLOCKS))


def bloom_bits(url: Column) -> Column:
    """A word with up to ``BITS`` bits set, from six-bit pieces of a second hash."""
    h = F.xxhash64(F.lit("bits"), url)
    word = F.lit(0).cast("long")
    for k in range(BITS):
        piece = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), piece))
    return word


def bloom(listed: DataFrame, url: str = "canonical") -> DataFrame:
    """(block, word) of the values of a column (URLs here; any type will do); at most ``BLOCKS`` rows."""
    u = F.col(url)
    return listed.where(u.isNotNull()).groupBy(bloom_block(u).alias("block")).agg(F.bit_or(bloom_bits(u)).alias("word"))


def in_list(urls: DataFrame, listed: DataFrame, key: str, url: str = "canonical") -> DataFrame:
    """The distinct values of ``key`` column in ``urls`` that are listed.

    Only URLs that the broadcast filter lets through reach the exact join.
    """
    u = F.col(key)
    asked = urls.select(key).where(u.isNotNull()).distinct()
    hits = (asked.withColumn("__block", bloom_block(u)).withColumn("__bits", bloom_bits(u))
            .join(F.broadcast(bloom(listed, url)), F.col("__block") == F.col("block"))
            .where(F.col("word").bitwiseAND(F.col("__bits")) == F.col("__bits")).select(key))
    return hits.join(listed.select(F.col(url).alias(key)).where(u.isNotNull()).distinct(), key, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and whether the canonical URL is listed, per row of ``pages``.

    ``listed`` has a column ``canonical``.
    """
    url = F.col("__url")
    named = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
             .withColumn("host", host_of(url)).withColumn("path", path_of(url))
             .withColumn("canonical", canonical(F.col("host"), F.col("path"))))
    found = in_list(named, listed, "canonical").withColumn("__listed", F.lit(True))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    is_listed = F.coalesce(F.col("__listed"), F.lit(False))
    return (named.join(found, "canonical", "left").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule",
                    F.coalesce(by_rule[F.col("rule")], F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
                    "canonical", is_listed.alias("listed")))
