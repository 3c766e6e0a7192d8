"""URL filter: path rules, and exact membership of hosts by a cascade of Bloom filters.

Rules name a host (with its subdomains) and a path prefix; the longest fitting one decides. All other
urls are decided by their host: hosts on the list are blocked. The list is held as a cascade: level 1
encodes the listed hosts; level 2 the unlisted hosts of the corpus that level 1 takes for listed;
level 3 the listed ones that level 2 takes for unlisted, and so on until no error is left. Since the
levels are built against all hosts that occur, membership is exact for them, and rows are judged by
bit tests alone, without a join. Bits come from XXH64 with one seed a probe; a level is a set of bit
positions gathered by bitmap aggregation and kept as one binary value of fixed, checked size.

Everything is DataFrame and SQL functions. Defined cases: a null url or one without "://" has an empty
host and path, fits no rule and is allowed; repeated rows each give a row; with no listed host the
cascade is empty and everything else is allowed. Only id and url are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, staged, table

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A host is listed if one of its labels holds one of these words as a part between hyphens.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "poker", "spam", "track", "viagra", "xxx")
FIRST_RATE, NEXT_RATE = 0.1, 0.5
MAX_LEVELS = 64
#: Most bits of a level; 2^30 bits (128 MB) hold some 150 million listed hosts.
MAX_BITS = 1 << 30
BITMAP_BITS = 32768


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_struct(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + prefix).alias("rule"))).otherwise(out)
    return out


def listed(host: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    return host.rlike(rf"(?:\A|[.-])(?:{'|'.join(words)})(?:[.-]|\z)")


def probe(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits))


class Level:
    """One Bloom filter: its bits as one binary column value per 32,768-bit bitmap, by number."""

    def __init__(self, keys: DataFrame, n: int, number: int, rate: float) -> None:
        self.number = number
        self.probes = max(1, round(-math.log2(rate)))
        need = math.ceil(n * self.probes / math.log(2)) or 1
        self.bits = BITMAP_BITS * max(1, math.ceil(need / BITMAP_BITS))
        if self.bits > MAX_BITS:
            raise ValueError(f"level {number} needs {self.bits} bits; deal the list out by host hash first")
        at = keys.select(F.explode(F.array(*(probe(F.col("host"), number, i, self.bits) for i in range(self.probes)))).alias("p"))
        # bitmap positions and bucket numbers count from 1
        maps = at.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m"))
        self.maps = {r["b"] - 1: bytes(r["m"]) for r in maps.collect()}

    def holds(self, key: Column) -> Column:
        """Whether all probes hit set bits."""
        maps = F.array(*(F.lit(self.maps.get(b, b"\0" * (BITMAP_BITS // 8))) for b in range(self.bits // BITMAP_BITS)))
        out = None
        for i in range(self.probes):
            p = probe(key, self.number, i, self.bits)
            byte = F.substring(F.get(maps, F.floor(p / BITMAP_BITS).cast("int")), (F.floor(p % BITMAP_BITS / 8) + 1).cast("int"), F.lit(1))
            bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (p % 8).cast("int")) == 1
            out = bit if out is None else out & bit
        return out


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for all hosts of ``universe`` (host, listed), which must be distinct."""
    universe = staged(universe, "hosts")
    levels: list[Level] = []
    inside, outside = universe.filter("listed"), universe.filter("not listed")
    while len(levels) < MAX_LEVELS:
        n = inside.count()
        if not n:
            return levels
        level = Level(inside, n, len(levels), NEXT_RATE if levels else FIRST_RATE)
        levels.append(level)
        inside, outside = outside.filter(level.holds(F.col("host"))), inside
    raise ValueError("the cascade doesn't end")


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership for every key of the universe: the first level that rejects decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """(key, host, path, rule, verdict) for each row."""
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = rows.groupBy("host").agg(F.lit(1)).select("host", listed(F.col("host"), words).alias("listed"))
    levels = cascade(universe)
    verdict = F.when(member(F.col("host"), levels), F.lit("block")).otherwise(F.lit("allow"))
    rows = rows.withColumn("r", rule_struct(F.col("host"), F.col("path"), rules))
    return rows.select("key", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), verdict).alias("verdict"))


def op3_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


_RULE_CASE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_VERDICT_CASE = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {"op3_url_filter_cascade": op3_url_filter_cascade}
ORACLE_SQL = {
    "op3_url_filter_cascade": rf"""
WITH parts AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (SELECT *, CASE {_RULE_CASE} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {_VERDICT_CASE} END,
                CASE WHEN regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
}
