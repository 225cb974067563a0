"""URL filters: host/path rules first, then a listed-host verdict from a Bloom filter cascade.

A cascade is a list of Bloom filters. Level 0 encodes the listed keys; level 1 the unlisted
keys of the universe that level 0 passes wrongly; level 2 the listed keys that level 1 passes,
and so on until a level passes nothing wrongly. Over the universe it was built from, membership
is exact, and a lookup is a few hashes against constants: no join.

Everything here is DataFrame expressions. The levels travel inside the plan as binary
constants, at most MAX_BYTES together; a larger list is looked up with a join instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Host labels whose hosts are listed.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BITS_PER_KEY, HASHES = 12, 4
MAX_BYTES = 32 << 20


@dataclass(frozen=True)
class Level:
    bits: int
    data: bytes


def _slot(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + probe)), F.lit(bits))


def _passes(key: Column, n: int, level: Level) -> Column:
    """Whether level n of the cascade passes the key."""
    hit = F.lit(True)
    for i in range(HASHES):
        slot = _slot(key, n, i, level.bits)
        byte = F.ascii(F.decode(F.substring(F.lit(level.data), (F.floor(slot / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        hit = hit & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))) != 0)
    return hit


def build_cascade(keys: DataFrame, max_bytes: int = MAX_BYTES) -> list[Level] | None:
    """Levels for keys(key, listed), distinct non-null keys, which is read several times.

    Empty if nothing is listed; None if the levels would pass max_bytes.
    """
    levels: list[Level] = []
    while True:
        n = len(levels)
        here = keys.filter(F.col("listed") == F.lit(n % 2 == 0))
        for i, level in enumerate(levels):  # what reaches level n has passed all before
            here = here.filter(_passes(F.col("key"), i, level))
        count = here.count()
        if not count:
            return levels
        bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
        if bits // 8 + sum(len(x.data) for x in levels) > max_bytes:
            return None
        slots = here.select(F.explode(F.array(*[_slot(F.col("key"), n, i, bits) for i in range(HASHES)])).alias("slot"))
        words = slots.groupBy(F.floor(F.col("slot") / 32).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 32).cast("int"))).alias("v"))
        data = bytearray(bits // 8)
        for w, v in words.collect():  # at most bits / 32 rows
            data[4 * w : 4 * w + 4] = v.to_bytes(4, "little")
        levels.append(Level(bits, bytes(data)))


def contains(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe: the first level that stops it decides."""
    found = F.lit(len(levels) % 2 == 1)
    for n, level in reversed(list(enumerate(levels))):
        found = F.when(_passes(key, n, level), found).otherwise(F.lit(n % 2 == 1))
    return found


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or none: empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def listed_hosts(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """(key): the hosts of pages that have one of the labels, as a blocklist would name them."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    return hosts.filter(F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in labels])))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    listed(key) are the blocked hosts; the cascade is built for all hosts of pages and then
    tells exactly which are listed. The longest rule (host and path together) that fits decides,
    of equally long ones the last given; else a listed host is blocked and any other allowed.
    Null urls and urls without :// have empty host and path, fit no rule and are allowed unless
    the empty host is listed. Null keys and keys that no page has play no part. Rows repeat as
    they do in the input; an empty table gives an empty result; other columns aren't read.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    blocked = listed.filter("key IS NOT NULL").select("key", F.lit(True).alias("_on")).distinct()
    keys = seen.select(F.col("host").alias("key")).distinct().join(blocked, "key", "left")
    keys = stored(keys.select("key", F.coalesce("_on", F.lit(False)).alias("listed")), "url-keys")
    levels = build_cascade(keys, max_bytes)
    if levels is None:
        seen = seen.join(keys.withColumnRenamed("key", "host"), "host")
    else:
        seen = seen.withColumn("listed", contains(F.col("host"), levels))
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its host, path, the rule that fits and the verdict."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_hosts(pages))


ORACLE = r"""
WITH seen AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), ruled AS (
  SELECT *, list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM seen
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
