"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

The corpus's complete universe of candidate keys (every host suffix with every path prefix that a rule could have) is known,
so a cascade is exact: level 1 encodes the listed keys, level 2 those other keys of the universe that pass level 1, level 3 the
listed keys that pass level 2, and so on until no key passes wrongly. The level that first rejects a key tells whether it is
listed. Level 1 takes as many bits for a key as leave about as many false positives as there are listed keys, so every level is in
proportion to the list, whatever the universe. A filter is one row of a written table, an array of 64-bit words; expressions read it
as a scalar subquery, and pages are never joined to a list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

# The rules of the contract, and the hosts of the block list.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED_HOSTS = [f"{name}.example.{zone}" for name in ("spam-farm", "cheap-pills", "ads-track") for zone in ("com", "net", "org")]


#: Bits that a key sets in a filter.
PROBES = 4


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table of one row with its words, how many bits they have, and its seed."""

    words: DataFrame
    bits: int
    seed: int


def _bit(key: Column, probe: int, bits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 64 + probe), key), F.lit(bits))


def bits_for(n_keys: int, wrong: float) -> int:
    """Bits of a filter of n_keys keys that lets through a share of about wrong of other keys, a multiple of 64."""
    return max(1, math.ceil(n_keys * PROBES / -math.log1p(-(wrong ** (1 / PROBES))) / 64)) * 64


def bloom_level(keys: DataFrame, key: str, bits: int, seed: int) -> Level:
    """A filter of bits bits. Words are made by bit_or, so a task sends each word once."""
    at = keys.select(F.explode(F.array(*(_bit(F.col(key), p, bits, seed) for p in range(PROBES)))).alias("b"))
    words = at.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v"))
    dense = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("v", F.lit(0)).alias("v"))
    row = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))
    return Level(materialise(row, "bloom-level"), bits, seed)


def may_contain(key: Column, level: Level) -> Column:
    words = level.words.scalar()
    bits = [_bit(key, p, level.bits, level.seed) for p in range(PROBES)]
    return reduce(lambda a, b: a & b, (F.call_function("getbit", F.element_at(words, (F.floor(b / 64) + 1).cast("int")), F.pmod(b, F.lit(64)).cast("int")) != 0 for b in bits))


def cascade(listed: DataFrame, universe: DataFrame, key: str = "key", most_wrong: float = 0.15) -> list[Level]:
    """Levels that decide membership in listed exactly, for every key of universe. Nulls aside, any rows do for listed; universe is distinct.

    The false positives of a level are encoded by the next, under a fresh seed. At most a share of about most_wrong passes each time, so
    what is encoded shrinks, and the loop ends when nothing passes. Listed keys outside the universe are dropped first: nobody asks for them. No
    listed key inside gives no level, and nothing is listed then. Repeated keys count once, null keys not at all; other columns are ignored.
    """
    listed, universe = listed.select(key).where(F.col(key).isNotNull()), universe.select(key).where(F.col(key).isNotNull())
    inside = materialise(listed.join(universe, key, "left_semi").distinct(), "bloom-listed")
    outside = materialise(universe.join(inside, key, "left_anti"), "bloom-others")
    levels: list[Level] = []
    encode, other = inside, outside
    n_encode, n_other = encode.count(), other.count()
    while n_encode:
        wrong = min(most_wrong, n_encode / max(1, n_other))
        level = bloom_level(encode, key, bits_for(n_encode, wrong), len(levels))
        levels.append(level)
        passed = materialise(other.where(may_contain(F.col(key), level)), "bloom-passed")
        encode, other = passed, encode
        n_encode, n_other = encode.count(), n_encode
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """True for a listed key: the first level to reject it is an even one (or none rejects it and their number is odd)."""
    result = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        result = F.when(may_contain(key, levels[i]), result).otherwise(F.lit(i % 2 == 1))
    return result


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path. Host: after the first :// up to / ? # or the end, A-Z lowered. Path: from there to ? or #."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lowered, "path": path})


def host_suffixes(host: Column, most_labels: int) -> list[Column]:
    """The last one, two, ... most_labels labels of a host: c and b.c for a.b.c and 2; null for an empty host, all of a shorter one."""
    return [F.when(host != "", F.substring_index(host, ".", -i)) for i in range(1, most_labels + 1)]


def rule_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> list[Column]:
    """Every rule that could fit: each host suffix of up to most_labels labels with each path prefix of one of these lengths, or null."""
    return [F.when(F.length(path) >= n, F.concat(h, path.substr(1, n))) for h in host_suffixes(host, most_labels) for n in lengths]


def _labels(hosts: list[str]) -> int:
    return max((h.count(".") + 1 for h in hosts), default=1)


def url_verdicts(pages: DataFrame, spark: SparkSession, rules: list[tuple[str, str]] = RULES, blocked_hosts: list[str] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict for every page, repeated rows included.

    rules: (verdict, host + path), a list that someone wrote down. blocked_hosts: another, or a table of any length with a column key.
    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones the first in
    string order. Without a rule, pages of a blocked host or its subdomains are blocked, others allowed. Null urls and those without
    :// have an empty host and path, no rule, and are allowed. Hosts of very many labels are cut to as many as a rule or listed host
    has. An empty table gives an empty result; other columns of pages are dropped.
    """
    lengths = sorted({len(r) - r.index("/") for _, r in rules}) or [1]
    labels = _labels([r[: r.index("/")] for _, r in rules])
    if isinstance(blocked_hosts, DataFrame):
        blocked = blocked_hosts.select("key").where(F.col("key").isNotNull())
        host_labels = blocked.agg(F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(1)).alias("n")).first().n
    else:
        blocked, host_labels = spark.createDataFrame([(k,) for k in blocked_hosts], "key string"), _labels(blocked_hosts)
    keys_of = rule_keys(F.col("host"), F.col("path"), lengths, labels)
    hosts_of = host_suffixes(F.col("host"), host_labels)
    parts = materialise(split_url(pages.select("page_id", "url")).select("page_id", "host", "path"), "url-parts")
    universe = materialise(parts.select(F.explode(F.array(*keys_of, *hosts_of)).alias("key")).where("key IS NOT NULL").distinct(), "url-keys")

    # rules have a slash and hosts have none, so one cascade knows what is blocked and another what is allowed
    listed = {v: spark.createDataFrame([(r,) for w, r in rules if w == v], "key string") for v in ("allow", "block")}
    allow, block = cascade(listed["allow"], universe), cascade(listed["block"].unionByName(blocked), universe)
    fits = [F.when(is_listed(k, allow) | is_listed(k, block), F.struct((-F.length(k)).alias("n"), k.alias("k"))) for k in keys_of]
    rule = F.array_min(F.array(*fits))["k"]  # null unless some rule fits
    blocked_host = reduce(lambda a, b: a | b, (F.coalesce(is_listed(h, block), F.lit(False)) for h in hosts_of))
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), blocked_host.alias("host_blocked"))
    verdict = F.when(F.when(F.col("rule").isNull(), F.col("host_blocked")).otherwise(is_listed(F.col("rule"), block)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
