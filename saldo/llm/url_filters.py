"""URL filters: allow and block rules, and a blocklist held in a Bloom filter cascade.

The cascade's levels alternate: level 0 holds the listed keys, level 1 the unlisted keys of the corpus that pass
level 0, level 2 the listed keys that pass level 1, and so on until no key passes. For every key of the universe
it was built over, the number of levels passed tells membership exactly. Judging is a projection: no join, no UDF.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed. Null keys
are never listed. An empty list allows every key. Repeated rows are judged alike. Columns that already bear an
output name are replaced; all others are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm.common import stored, table

#: Bits of one bitmap that ``bitmap_construct_agg`` builds.
PAGE_BITS = 32768

#: (host, path, verdict): fixed values of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Names that put a site on the query's blocklist.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty without ``://``."""
    absolute = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(F.regexp_replace(url, "(?s)^.*?://", ""), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.instr(rest, "/")
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise("")
    return F.when(absolute, host).otherwise(""), F.when(absolute, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for where, start, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        rule = F.when(fits, where + start) if rule is None else rule.when(fits, where + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.size)) for j in range(self.hashes)])

    def holds(self, key: Column) -> Column:
        """Whether every position of the key is set."""
        test = F.lit(True)
        for j in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(j)), F.lit(self.size))
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
            test = test & (F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1)
        return test


def _level(keys: DataFrame, count: int, bits_per_key: float, seed: int) -> Level:
    """One Bloom filter over ``keys``; its bytes are bounded by the caller's choice of shards."""
    size = PAGE_BITS * max(1, math.ceil(count * bits_per_key / PAGE_BITS))
    hashes = max(1, round(bits_per_key * math.log(2)))
    empty = Level(b"", size, hashes, seed)
    at = keys.select(F.explode(empty.positions(F.col("key"))).alias("at"))
    pages = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")
    )
    data = bytearray(size // 8)
    for row in pages.collect():  # size / PAGE_BITS rows: the filter itself
        start = (row["page"] - 1) * (PAGE_BITS // 8)
        data[start : start + len(row["bits"])] = row["bits"]
    return Level(bytes(data), size, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of one universe, in ``shards`` parts by key hash."""

    shards: tuple[tuple[Level, ...], ...]

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(len(self.shards)))

    def _listed(self, key: Column, levels: tuple[Level, ...]) -> Column:
        answer = F.lit(len(levels) % 2 == 1)  # passed every level: of the kind that the last level holds
        for depth in reversed(range(len(levels))):
            answer = F.when(levels[depth].holds(key), answer).otherwise(F.lit(depth % 2 == 1))
        return F.when(key.isNotNull(), answer).otherwise(False)

    def flag(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Add whether ``key`` is listed. One projection; a cascade of several shards takes one pass for each."""
        column = F.col(key)
        if len(self.shards) == 1:
            return df.withColumn(out, self._listed(column, self.shards[0]))
        passes = [
            df.filter(F.coalesce(self.shard(column), F.lit(0)) == n).withColumn(out, self._listed(column, levels))
            for n, levels in enumerate(self.shards)
        ]
        joined = passes[0]
        for one in passes[1:]:
            joined = joined.unionByName(one)
        return joined


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: float = 8.0, max_bytes: int = 4 << 20) -> Cascade:
    """A cascade over two one-column tables of keys.

    Every key that will be judged must be in ``universe`` or ``listed``. ``max_bytes`` bounds level 0 of a shard, which
    is what travels with the plan; a longer list is cut into more shards by key hash.
    """
    keys = listed.select(F.col(listed.columns[0]).alias("key")).filter("key is not null").distinct()
    keys = stored(keys, "listed")
    others = universe.select(F.col(universe.columns[0]).alias("key")).filter("key is not null").distinct()
    others = stored(others.join(keys, "key", "left_anti"), "unlisted")
    count = keys.count()
    parts = max(1, math.ceil(count * bits_per_key / 8 / max_bytes))
    frame = Cascade(((),) * parts)
    shards = []
    for n in range(parts):
        inside, outside = (side.filter(frame.shard(F.col("key")) == n) for side in (keys, others))
        levels: list[Level] = []
        size = inside.count()
        while size:
            # below level 0 the sets are about balanced, where few bits a key end the cascade soonest
            level = _level(inside, size, bits_per_key if not levels else max(2.0, bits_per_key / 2), len(levels))
            levels.append(level)
            inside, outside = stored(outside.filter(level.holds(F.col("key"))), "passed"), inside
            size = inside.count()
        shards.append(tuple(levels))
    return Cascade(tuple(shards))


def judge(pages: DataFrame, cascade: Cascade, rules=RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. A rule decides if one fits, else the cascade: block if listed."""
    host, path = host_and_path(F.col(url))
    placed = pages.withColumns({"host": host, "path": path})
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    flagged = cascade.flag(placed.withColumns({"rule": rule, "__said": said}), "host", "__listed")
    verdict = F.coalesce("__said", F.when(F.col("__listed"), "block").otherwise("allow"))
    return flagged.withColumn("verdict", verdict).drop("__said", "__listed")


def op2_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    """Judge every page's url. Listed are the hosts of the corpus with a label of ``LISTED_NAMES``."""
    pages = table(spark, directory, "pages").select("page_id", "url")
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("key")).distinct()
    hosts = stored(hosts, "hosts")
    listed = hosts.filter(F.arrays_overlap(F.split("key", "[.]"), F.array(*[F.lit(n) for n in LISTED_NAMES])))
    return judge(pages, build_cascade(listed, hosts)).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
with cut as (
  select page_id, case when contains(url, '://') then split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1)
         else '' end as rest
  from pages),
placed as (
  select page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) as path
  from cut),
ruled as (
  select *, case
    when ends_with('.' || host, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when ends_with('.' || host, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when ends_with('.' || host, '.com') and starts_with(path, '/fr/') then 'com/fr/'
    when ends_with('.' || host, '.com') and starts_with(path, '/de/') then 'com/de/'
    when ends_with('.' || host, '.org') and starts_with(path, '/') then 'org/' end as rule
  from placed)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when list_has_any(string_split(host, '.'), [{", ".join(f"'{n}'" for n in LISTED_NAMES)}]) then 'block' else 'allow' end as verdict
from ruled"""
