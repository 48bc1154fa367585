"""URL filter: host and path rules first, then a list of blocked canonical URLs.

The list is tested by a blocked Bloom filter: an URL's hash picks one block of 256 bits, and eight bits inside it must be
set. The filter is a table of blocks that pages meet by block number, at every length of the list; Spark sends it to all
tasks only while it knows it to be small. The few possible hits then go through an exact hash join with the list, which
removes the false positives. Pages are read once.

Defined results: an url that is null or has no ``://`` has an empty host and path, no rule and the verdict allow; very long
urls are taken whole; null ids are kept; repeated rows each give a row; of rules of equal length the longer host's holds,
then the first by text; an empty list blocks nothing; an empty table gives an empty result; other columns may have any name
and are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Workspace, ascii_lower

#: (host, path, verdict) of the rules in force.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
BITS_PER_URL = 16
PROBES = 8
BLOCK_BITS = 256
SEED = 7_919


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without trailing slashes, query without tracking parameters, no fragment."""
    query = F.concat(F.lit("&"), F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1))
    query = F.regexp_replace(query, r"&(utm_[^&=]*|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(
        F.regexp_replace(host_of(url), r"^(www|m)\.", ""),
        F.regexp_replace(path_of(url), r"/+$", ""),
        F.when(F.coalesce(query, F.lit("")) == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equal length: of the longest host, then the first by text)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[0] + r[1])):
        fit = fits(host, path, rule_host, rule_path)
        text = F.when(fit, rule_host + rule_path).otherwise(text)
        verdict = F.when(fit, said).otherwise(verdict)
    return text, verdict


def probes(url: Column) -> Column:
    """Positions of the URL's bits in its block, as an array of ints."""
    second = F.xxhash64(url, F.lit(SEED))
    return F.array(*[F.shiftrightunsigned(second, 8 * k).bitwiseAND(BLOCK_BITS - 1).cast("int") for k in range(PROBES)])


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """One row for each block in use: its number and four 64-bit words."""
    bits = listed.select(
        F.pmod(F.xxhash64("url"), F.lit(n_blocks)).alias("block"), F.explode(probes(F.col("url"))).alias("bit")
    )
    words = [
        F.bit_or(F.expr(f"CASE WHEN bit DIV 64 = {k} THEN shiftleft(1L, bit % 64) ELSE 0L END")).alias(f"w{k}")
        for k in range(BLOCK_BITS // 64)
    ]
    return bits.groupBy("block").agg(*words)


def possible(bits: Column) -> Column:
    """All of the probed bits are set in the block of the row (columns w0..w3)."""
    word = F.array(*[F.col(f"w{k}") for k in range(BLOCK_BITS // 64)])
    return F.forall(bits, lambda b: F.getbit(F.get(word, F.floor(b / 64).cast("int")), F.pmod(b, F.lit(64))) == 1)


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per page row: id, host, path, rule, verdict, canonical url, and whether the filter and the list hold that url.

    ``listed`` has one column, the canonical URLs to block; repeated and null entries count once or not at all."""
    space = Workspace(pages.sparkSession)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    judged = (
        urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("url"))
        .withColumn("rule", rule)
        .withColumn("said", said)
    )
    block_list = space.write(listed.toDF("url").filter("url IS NOT NULL").distinct(), "listed-urls")
    n_blocks = max(1, -(-block_list.count() * BITS_PER_URL // BLOCK_BITS))
    blocks = space.write(bloom_blocks(block_list, n_blocks), "bloom-blocks")
    tested = judged.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(n_blocks))).join(blocks, "block", "left")
    maybe = F.coalesce(possible(probes(F.col("url"))), F.lit(False))
    tested = space.write(tested.select("id", "host", "path", "url", "rule", "said", maybe.alias("maybe")), "tested-urls")
    space.drop("bloom-blocks")
    # Only possible hits meet the list. Both sides are plain exchanges, so that a hot URL's partition is split at run time.
    found = tested.filter("maybe").join(block_list.withColumn("on_list", F.lit(True)), "url", "left")
    listed_or_not = found.withColumn("listed", F.coalesce("on_list", F.lit(False))).drop("on_list")
    out = listed_or_not.unionByName(tested.filter("NOT maybe").withColumn("listed", F.lit(False)))
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("url").alias("canonical"),
        "maybe",
        "listed",
    )


#: Host words of known link farms; the registered query lists the canonical URLs of pages on such hosts.
FARM_HOSTS = r"(^|[.-])(spam|pills|casino)([.-]|$)"


def listed_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs of pages on link-farm hosts."""
    return pages.filter(host_of(F.col(url_col)).rlike(FARM_HOSTS)).select(canonical_url(F.col(url_col)).alias("url"))
