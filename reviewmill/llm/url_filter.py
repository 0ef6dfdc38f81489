"""Allow or block URLs by rules, with a blocked Bloom filter before the exact join."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewmill.llm.common import ascii_lower, bounded_broadcast, materialise

#: Filter bits per rule, bits set per rule, and the most 64-bit blocks of the filter.
RULE_BITS, PROBES, MAX_BLOCKS = 16, 4, 1 << 20

# The rules (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, in lower case; '' without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def _bits(host: Column, path: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and the bits it sets there, from one 64-bit hash."""
    h = F.xxhash64(host, path)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.shiftrightunsigned(h, 6 * PROBES), F.lit(blocks)), mask


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as (block, bits); blocks without a rule are left out. It has at most
    MAX_BLOCKS rows of 16 bytes."""
    block, mask = _bits(F.col("host"), F.col("path"), blocks)
    return rules.select(block.alias("__block"), mask.alias("__mask")).groupBy("__block").agg(
        F.bit_or("__mask").alias("__bits"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict (which replace columns of that name).

    A rule fits its host and all subdomains, where the path starts with the rule's; the
    longest rule wins (of equally long ones that with the longer host); of rules of one
    host and path, block wins. A URL that no
    rule fits gets the default and a null rule; null URLs and those without :// have
    empty host and path and fit none. Repeated URLs get one verdict each.
    """
    rules = materialise(rules.groupBy("host", "path").agg(
        F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.min("verdict")).alias("verdict")), "url-rules")
    shape = rules.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))),
                      F.sort_array(F.collect_set(F.char_length("path")))).first()
    blocks = 1
    while blocks * 64 < shape[0] * RULE_BITS and blocks < MAX_BLOCKS:
        blocks *= 2
    urls = pages.select(url_host(F.col(url_col)).alias("__host"), url_path(F.col(url_col)).alias("__path"))
    labels = F.split("__host", r"\.")
    keyed = (
        urls.where(F.col("__host") != "")
        # at most one suffix per label of the longest listed host, and one prefix per listed length
        .withColumn("__depth", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape[1] or 1)))))
        .withColumn("__suffix", F.array_join(F.slice(labels, -F.col("__depth"), F.col("__depth")), "."))
        .withColumn("__length", F.explode(F.array(*[F.lit(n) for n in shape[2] or [0]])))
        .where(F.char_length("__path") >= F.col("__length"))
        .withColumn("__prefix", F.substring(F.col("__path"), F.lit(1), F.col("__length"))))
    block, mask = _bits(F.col("__suffix"), F.col("__prefix"), blocks)
    possible = keyed.withColumns({"__block": block, "__mask": mask}).join(
        F.broadcast(bloom_blocks(rules, blocks)), "__block").where(
        F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"))
    listed = bounded_broadcast(rules.select(
        F.col("host").alias("__suffix"), F.col("path").alias("__prefix"), F.col("verdict").alias("__verdict")))
    best = possible.join(listed, ["__suffix", "__prefix"]).groupBy("__host", "__path").agg(F.max(F.struct(
        (F.char_length("__suffix") + F.char_length("__prefix")).alias("length"),
        F.char_length("__suffix").alias("host_length"),
        F.concat("__suffix", "__prefix").alias("rule"), F.col("__verdict").alias("verdict"))).alias("__best"))
    judged = pages.withColumns({"__h": url_host(F.col(url_col)), "__p": url_path(F.col(url_col))}).join(
        best, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__path")), "left")
    new = {"host": F.col("__h"), "path": F.col("__p"), "rule": F.col("__best.rule"),
           "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}
    return judged.withColumns(new).select(*pages.columns, *[c for c in new if c not in pages.columns])
