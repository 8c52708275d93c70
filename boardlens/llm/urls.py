"""URL filtering by rules and by a Bloom filter cascade.

A cascade stores a listed key set exactly with respect to a complete universe of
keys: level 0 is a Bloom filter of the listed keys, level 1 one of those unlisted
keys that level 0 lets through by mistake, level 2 one of the listed keys that
level 1 lets through, and so on until no mistake is left. A key of the universe
is listed exactly if the first level it fails is odd. Only bit arrays travel,
never the list itself.

Keys are dealt over shards, each with its own levels, so that one bit array has
a bounded size; the shards' arrays together are broadcast only up to
``BROADCAST_BITS``, and joined on the shard number beyond that.

NULL urls and urls without ``://`` have an empty host and path, fit no rule, are
listed under no key and get ``allow``. Repeated rows are judged each; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm.text import ascii_lower, columns_or_null
from boardlens.session import settled

# Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
SHARD_KEYS = 50_000
BITS_PER_KEY = 6
PROBES = 4
MAX_LEVELS = 40
BROADCAST_BITS = 8 * 32 * 1024 * 1024
QUERY_SHARE = 0.5


def host_of(url: str | Column = "url") -> Column:
    """Host between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str | Column = "url") -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fit(rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host and path, else NULL."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [
        ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for h, p, _ in ranked
    ]

    def pick(values):
        out = F.lit(None).cast("string")
        for fit, value in reversed(list(zip(fits, values, strict=True))):
            out = F.when(fit, F.lit(value)).otherwise(out)
        return out

    return pick([h + p for h, p, _ in ranked]), pick([v for _, _, v in ranked])


def _probes(level: int, bits: Column) -> list[Column]:
    """Bit numbers of a key in its shard's array of one level."""
    return [F.pmod(F.xxhash64(F.lit(level * PROBES + i), "key"), bits) for i in range(PROBES)]


def _bit_arrays(keys: DataFrame, level: int) -> DataFrame:
    """One level: per shard the number of bits, and the bits as 64-bit words in order."""
    sizes = keys.groupBy("shard").agg(
        (F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64) * 64).cast("bigint").alias("bits"))
    empty_words = sizes.select(
        "shard", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("bits", 6) - 1)).alias("at"),
        F.lit(0).cast("bigint").alias("word"))
    set_bits = (
        keys.join(sizes, "shard")
        .select("shard", "bits", F.explode(F.array(*_probes(level, F.col("bits")))).alias("bit"))
        .select("shard", "bits", F.shiftright("bit", 6).alias("at"),
                F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("word")))
    words = set_bits.unionByName(empty_words).groupBy("shard", "bits", "at").agg(F.bit_or("word").alias("word"))
    # At most about SHARD_KEYS * BITS_PER_KEY / 64 words meet here.
    return words.groupBy("shard", "bits").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select(
        "shard", F.col("bits").alias(f"bits_{level}"), F.col("w.word").alias(f"words_{level}"))


def _passes(level: int) -> Column:
    """Whether all bits of ``key`` are set in the level; false where the shard lacks it."""
    words = F.col(f"words_{level}")
    tests = [
        F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.expr("63").bitwiseAND(p).cast("int")) == 1
        for p in _probes(level, F.col(f"bits_{level}"))
    ]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


class Cascade:
    """The levels of a cascade and how to ask them.

    ``universe`` has one row per key: ``key`` string, ``listed`` boolean.
    """

    def __init__(self, universe: DataFrame):
        keys = settled(universe.select("key", "listed"), "cascade-keys")
        self.listed = keys.where("listed").count()
        self.shards = max(1, -(-self.listed // SHARD_KEYS))
        keys = keys.withColumn("shard", self.shard())
        inside, outside = keys.where("listed"), keys.where("NOT listed")
        self.levels: list[DataFrame] = []
        while not inside.isEmpty():
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("the cascade does not end: keys of the universe are not distinct")
            level = len(self.levels)
            self.levels.append(settled(_bit_arrays(inside, level), f"cascade-level-{level}"))
            mistaken = outside.join(self.levels[-1], "shard", "left").where(_passes(level)).select(*keys.columns)
            inside, outside = settled(mistaken, f"cascade-next-{level}"), inside

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(self.shards))

    def ask(self, df: DataFrame, name: str = "listed") -> DataFrame:
        """``df`` (with a ``key`` of the universe) and whether that key is listed."""
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        arrays = reduce(lambda a, b: a.join(b, "shard", "left"), self.levels)
        # Level sizes shrink geometrically, so twice level 0 bounds them all.
        if 2 * self.listed * BITS_PER_KEY <= BROADCAST_BITS:
            arrays = F.broadcast(arrays)
        first_failed = F.lit(len(self.levels))
        for level in reversed(range(len(self.levels))):
            first_failed = F.when(~_passes(level), F.lit(level)).otherwise(first_failed)
        drop = [c for level in range(len(self.levels)) for c in (f"bits_{level}", f"words_{level}")]
        asked = df.withColumn("shard", self.shard()).join(arrays, "shard", "left")
        return asked.withColumn(name, first_failed % 2 == 1).drop("shard", *drop)


def queried_hosts(parts: DataFrame, share: float = QUERY_SHARE) -> DataFrame:
    """All hosts; listed are those of which at least ``share`` of the pages have a query string."""
    return (
        parts.groupBy(F.col("host").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("queried").alias("q"))
        .select("key", ((F.col("key") != "") & (F.col("q") >= F.lit(share) * F.col("n"))).alias("listed")))


def judge(pages: DataFrame, rules=RULES, share: float = QUERY_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` (the cascade's answer for the host)."""
    parts = columns_or_null(pages, page_id="bigint", url="string").select(
        "page_id", host_of("url").alias("host"), path_of("url").alias("path"),
        F.coalesce(F.col("url").rlike(r"(?s)^[^#]*\?"), F.lit(False)).alias("queried"))
    cascade = Cascade(queried_hosts(parts, share))
    asked = cascade.ask(parts.withColumn("key", F.col("host"))).drop("key", "queried")
    rule, verdict = rule_fit(rules)
    return asked.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
    coalesce(instr(split_part(url, '#', 1), '?') > 0, false) AS queried FROM pages),
h AS (
  SELECT page_id, queried, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT host, host <> '' AND count(*) FILTER (queried) >= CAST(0.5 AS DOUBLE) * count(*) AS listed FROM h GROUP BY host),
f AS (SELECT page_id, host, path, listed, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h JOIN l USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM f"""
