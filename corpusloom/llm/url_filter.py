"""URL filters: allow and block rules by host and path, and a list of canonical URLs to block.

Native: DataFrame functions only. Rules and listed URLs become canonical keys (host, then path prefix). A blocked
Bloom filter over the keys (one 64-bit word for each block, built with ``bit_or``) is probed with each URL's possible
keys: its host suffixes times the path-prefix lengths that rules have. Possible hits go to an exact hash join that
removes false positives; the longest rule wins. Filter words are broadcast only while their counted size is under
``BROADCAST_WORDS``; beyond it the probe is a shuffled join.

Defined cases: a null URL or one without ``://`` has an empty host and path; it matches no rule and no listed URL and
is allowed; an empty path starts with no rule's path, not even ``/``. Ports and user names are part of the host text. Ties between rules of the same length cannot occur for
one URL unless a rule is given twice with two verdicts: then block wins. Rows repeat as the input does; an empty rule
table or list lets everything through; other columns are kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of filter for a key, bits set for a key, and the most filter words that are broadcast (16 MB).
BITS_PER_KEY, BITS_SET, BROADCAST_WORDS = 16, 4, 1_000_000


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host and path in one text: scheme, query and fragment dropped; null where there is no host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, url_path(url)))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _mask(key: Column) -> Column:
    """BITS_SET bits of the key's one 64-bit block."""
    h, word = F.xxhash64(F.lit(11), key), F.lit(0).cast("long")
    for i in range(BITS_SET):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return word


def bloom_words(keys: DataFrame) -> tuple[DataFrame, int]:
    """(blk, word) rows of a blocked Bloom filter over column key, and its number of blocks."""
    n = keys.count()
    blocks = max(1, -(-n * BITS_PER_KEY // 64))
    words = keys.select(_block(F.col("key"), F.lit(blocks)).alias("blk"), _mask(F.col("key")).alias("m")).groupBy("blk").agg(F.bit_or("m").alias("word"))
    return words, blocks


def bloom_hits(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of probes (column key) that may be in keys: every true one and a few false ones."""
    words, blocks = bloom_words(keys)
    words = F.broadcast(words) if blocks <= BROADCAST_WORDS else words
    marked = probes.withColumn("_blk", _block(F.col("key"), F.lit(blocks))).withColumn("_m", _mask(F.col("key")))
    hit = (F.col("_blk") == F.col("blk")) & (F.col("word").bitwiseAND(F.col("_m")) == F.col("_m"))
    return marked.join(words, hit).drop("_blk", "_m", "blk", "word")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, verdict); path is a prefix such as ``/en/``, or ``/`` for all of a host. listed: (url).
    """
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)  # A-Z only, as of URLs
    rules = rules.groupBy(F.concat(host, F.lit("|"), F.col("path")).alias("key"), host.alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    rules = rules.withColumn("r_rule", F.concat("r_host", "r_path"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    n_rules = rules.count()
    # Distinct prefix lengths of rules: no more than the longest URL's length, whatever the number of rules.
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    keyed = pages.select(F.col("host"), F.col("path")).where(F.col("host") != "").distinct()
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull()))
    probes = keyed.select("host", "path", F.explode(prefixes).alias("prefix")).select("host", "path", "prefix", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
    probes = probes.select("host", F.col("path").alias("url_path"), F.concat("suffix", F.lit("|"), "prefix").alias("key"))
    hits = bloom_hits(probes, rules.select("key"))
    found = hits.join(F.broadcast(rules) if n_rules <= BROADCAST_WORDS // 16 else rules, "key")
    best = found.groupBy("host", F.col("url_path").alias("path")).agg(F.max(F.struct(F.length("r_rule").alias("n"), F.col("r_verdict"), F.col("r_rule"))).alias("r"))
    urls = listed.select(canonical_url(F.col("url")).alias("key")).where(F.col("key").isNotNull()).distinct()
    canon = keyed.withColumn("key", F.concat("host", "path"))
    on_list = bloom_hits(canon, urls).join(urls, "key", "left_semi").select("host", "path", F.lit(True).alias("is_listed"))
    out = pages.join(best, ["host", "path"], "left").join(on_list, ["host", "path"], "left")
    verdict = F.coalesce(F.col("r.r_verdict"), F.when(F.col("is_listed"), "block"), F.lit("allow"))
    return out.select(*[pages[c] for c in pages.columns], F.col("r.r_rule").alias("rule"), verdict.alias("verdict"))
