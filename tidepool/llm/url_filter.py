"""Operator 8: URL rules judged by Bloom filter cascades (native: DataFrame functions only).

A cascade answers "is this key listed?" exactly for every key of the corpus. Level 0 is a Bloom filter of the listed
keys. Level 1 holds those unlisted keys of the corpus that level 0 lets through, level 2 those listed keys that level 1
lets through, and so on until a level lets nothing false through. The levels are small binary literals in the plan, so
judging a page needs no join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK = 1 << 13  # bytes of a level that come to the driver in one row
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The keys (host suffix + path prefix) under which a rule could list a page, as an array of (size, labels, key).

    ``labels``: most labels of a rule's host; ``lengths``: the lengths of the rules' paths. Both come from the rules,
    so a very long host or path makes no more candidates than a short one.
    """
    parts = F.split(host, r"\.", -1)
    found = []
    for n in range(1, labels + 1):
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
        for size in lengths:
            key = F.concat(suffix, F.substring(path, 1, size) if size else F.lit(""))
            fits = (F.size(parts) >= n) & (F.length(path) >= size) & (host != "")
            found.append(F.when(fits, F.struct(F.length(key).alias("size"), F.lit(n).alias("labels"), key.alias("key"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Level:
    bits: bytes  # seven bits a byte, so that a byte is an ASCII character, whose code a built-in function gives
    size: int
    hashes: int

    def has(self, key: Column, level: int) -> Column:
        out = F.lit(True)
        for p in _positions(key, level, self.size, self.hashes):
            byte = F.ascii(F.substring(F.lit(self.bits), (F.floor(p / 7) + 1).cast("int"), F.lit(1)).cast("string"))
            out = out & (F.getbit(byte, F.pmod(p, F.lit(7)).cast("int")) == 1)
        return out


def _positions(key: Column, level: int, size, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), size if isinstance(size, Column) else F.lit(size)) for i in range(hashes)]


def _levels(keys: DataFrame, counts: dict[int, int], level: int, rate: float) -> dict[int, Level]:
    """A Bloom filter for each shard of keys(key, shard). Tasks put CHUNK bytes together, of which the driver gets a row each."""
    hashes = max(1, round(-math.log2(rate)))
    sizes = {shard: max(70, math.ceil(n * hashes / math.log(2))) for shard, n in counts.items()}
    size = F.lit(0)
    for shard, n in sizes.items():
        size = F.when(F.col("shard") == shard, F.lit(n)).otherwise(size)
    at = keys.select("shard", F.explode(F.array(*_positions(F.col("key"), level, size, hashes))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(7)).cast("int"))
    cells = at.groupBy("shard", F.floor(F.col("p") / 7).alias("byte")).agg(F.bit_or(bit).alias("bits"))
    # the bytes of a chunk in order, with zero bytes where no key has a bit
    cells = cells.withColumn("chunk", F.floor(F.col("byte") / CHUNK)).withColumn("byte", F.pmod("byte", F.lit(CHUNK)).cast("int"))
    chunks = cells.groupBy("shard", "chunk").agg(F.array_sort(F.collect_list(F.struct("byte", "bits"))).alias("held"))  # at most CHUNK bytes
    last = F.concat(F.array(F.lit(-1)), F.transform("held", lambda h: h["byte"]))
    text = F.zip_with("held", F.slice(last, 1, F.size("held")), lambda h, p: F.concat(F.repeat(F.lit("\0"), h["byte"] - p - 1), F.chr(h["bits"])))
    bits = {shard: bytearray(-(-n // 7)) for shard, n in sizes.items()}
    for shard, chunk, held in chunks.select("shard", "chunk", F.array_join(text, "")).toLocalIterator():
        bits[shard][chunk * CHUNK : chunk * CHUNK + len(held)] = held.encode("ascii")
    return {shard: Level(bytes(bits[shard]), n, hashes) for shard, n in sizes.items()}


@dataclass(frozen=True)
class Cascade:
    """Levels by shard of the key space; with one shard, every key is in it. ``left``: keys that the levels don't tell apart."""

    shards: tuple[tuple[Level, ...], ...]
    left: tuple[str, ...] = ()

    def has(self, key: Column) -> Column:
        out = None
        for n, levels in enumerate(self.shards):
            one = F.lit(len(levels) % 2 == 1)  # let through by all: in what the last level holds, but for those left
            if self.left:
                one = F.when(key.isin(*self.left), len(levels) % 2 == 0).otherwise(one)
            for at in reversed(range(len(levels))):
                one = F.when(levels[at].has(key, at), one).otherwise(at % 2 == 1)
            out = one if out is None else F.when(_shard(key, len(self.shards)) == n, one).otherwise(out)
        return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def build_cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = 1 << 20, most_levels: int = 40) -> Cascade:
    """A cascade for ``listed(key)`` that is exact on every key of ``universe(key)`` and of ``listed``.

    The key space is cut by hash into shards of about ``shard_keys`` listed keys, each with levels of its own, so a level
    holds a few MB at most, however many keys are listed; only these levels' bytes come to the driver, a row for CHUNK of
    them. Keys that ``most_levels`` levels can't tell apart (of equal hashes) are kept as they are. Null keys are left
    out; repeated keys count once; an empty list gives a cascade that lists nothing.
    """
    keys = universe.select("key", F.lit(0).alias("listed")).unionByName(listed.select("key", F.lit(1).alias("listed")))
    keys = settle(keys.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
    total, rest = keys.agg(F.coalesce(F.sum("listed"), F.lit(0)), F.count("*") - F.coalesce(F.sum("listed"), F.lit(0))).first()
    shards = max(1, -(-total // shard_keys))
    keys = keys.select("key", "listed", (_shard(F.col("key"), shards) if shards > 1 else F.lit(0)).alias("shard"))
    inside, outside = (keys.filter(F.col("listed") == i).select("key", "shard") for i in (1, 0))
    made: list[list[Level]] = [[] for _ in range(shards)]
    for level in range(most_levels):
        counts = {r.shard: r.n for r in inside.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        if not counts:
            return Cascade(tuple(map(tuple, made)))
        n = sum(counts.values())
        rate = 0.5 if level else min(0.5, max(n * math.sqrt(0.5) / max(rest, 1), 1e-9))
        passes = F.lit(False)
        for shard, one in _levels(inside, counts, level, rate).items():
            made[shard].append(one)
            passes = F.when(F.col("shard") == shard, one.has(F.col("key"), level)).otherwise(passes)
        through = outside.filter(passes)
        inside, outside = settle(through) if total + rest > 100_000 else through, inside
    # each level halves what is left, so only keys with equal hashes come here: these are listed one by one
    return Cascade(tuple(map(tuple, made)), tuple(sorted(r.key for r in inside.collect())))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages(page_id, url)`` by ``rules`` of (host, path, verdict): page_id, url, host, path, rule, verdict.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path. The longest fitting rule
    wins; of equally long ones that with more host labels. A page that no rule lists gets ``default``. Null or malformed
    URLs have empty host and path and fit no rule; repeated rows are judged each; other columns are ignored; an empty
    table gives an empty result. Without rules every page gets ``default``.
    """
    rules = [(h.translate(str.maketrans(UPPER, LOWER)), p, v) for h, p, v in rules]
    if len({h + p for h, p, _ in rules}) < len(rules) or {v for *_, v in rules} - {"allow", "block"}:
        raise ValueError("each rule needs its own host and path, and allow or block")
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels, lengths = max([h.count(".") + 1 for h, *_ in rules], default=0), sorted({len(p) for _, p, _ in rules})
    if not rules:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths)
    universe = settle(seen.select(F.explode(keys).alias("k")).select("k.key").distinct())
    made = {v: build_cascade(universe, spark.createDataFrame([(h + p,) for h, p, x in rules if x == v], "key string")) for v in ("block", "allow")}
    fit = lambda v: F.array_max(F.filter(keys, lambda k: made[v].has(k["key"])))
    out = seen.select("*", fit("block").alias("b"), fit("allow").alias("a"))
    best = F.greatest("a", "b")  # nulls are skipped
    verdict = F.when(F.col("b").isNull() & F.col("a").isNull(), default).when(F.col("a").isNull() | (F.col("b") > F.col("a")), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(k := rhost || rpath, v := v), length(rhost || rpath)) FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.k AS rule, coalesce(best.v, 'allow') AS verdict FROM f
"""
