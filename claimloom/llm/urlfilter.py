"""URL rules by a cascade of Bloom filters, in DataFrame functions only.

A rule is a (host, path) pair: it fits its host and all subdomains when the URL's
path starts with the rule's path.  The keys a URL could match are its host's
suffixes, each with those beginnings of its path that are as long as some rule's
path.  All such keys of the corpus form the key universe.

Level 1 of a cascade holds the listed keys.  Of the universe, the unlisted keys that
level 1 lets through by mistake go into level 2, the listed keys that level 2 lets
through go into level 3, and so on until a level makes no mistake.  A key is then
listed exactly when the first level that lacks it is an even one (or, if no level
lacks it, when the number of levels is odd), so membership is exact over the whole
universe and URLs are judged without a join: a level is one binary constant, of two or three
bits per key that it holds.  Lists whose cascades would be larger than ``MAX_FILTER_BYTES`` are
judged by joins with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, materialize

Rule = tuple[str, str, str]
#: Separates host and path in a key; neither can hold it, as a host ends at "/".
SEP = "/"
#: All cascades together; constants go to every task with the plan.  About 12 million rules fit.
MAX_FILTER_BYTES = 4 << 20
MAX_LEVELS = 64
#: Bits in a value of Spark's bitmap aggregates (fixed value).
BITMAP = 8 * 4096


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """The keys that may fit a URL, longest first; ties: the longer host first."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    paths = F.array(*[F.substring(path, 1, k) for k in sorted(path_lengths, reverse=True)])
    paths = F.array_distinct(F.filter(F.zip_with(paths, F.array(*[F.lit(k) for k in sorted(path_lengths, reverse=True)]), lambda p, k: F.when(F.length(p) == k, p)), lambda p: p.isNotNull()))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.struct((-F.length(s) - F.length(p)).alias("l"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(keys), lambda x: x["key"]))


class TooLarge(ValueError):
    """The filters would be larger than allowed."""


class Level:
    """One Bloom filter: ``bits`` in all as a binary column ``filter``, ``hashes`` per key."""

    def __init__(self, number: int, bits: int, hashes: int) -> None:
        self.number, self.bits, self.hashes = number, bits, hashes
        self.filter: Column | None = None

    @classmethod
    def sized(cls, number: int, keys: int, rate: float) -> Level:
        bits = max(64, ceil(keys * log(1 / rate) / log(2) ** 2))
        return cls(number, -(-bits // 64) * 64, max(1, round(log(1 / rate) / log(2))))

    def positions(self, key: Column) -> Column:
        """The key's bits; two hashes give them all, and each level has hashes of its own."""
        a, b = F.xxhash64(key, F.lit(2 * self.number)), F.xxhash64(key, F.lit(2 * self.number + 1))
        return F.array(*[F.pmod(F.shiftright(a, 2) + F.lit(i) * F.shiftright(b, 8), F.lit(self.bits)) for i in range(self.hashes)])

    def fill(self, keys: DataFrame) -> None:
        """Set the keys' bits in bitmaps of 4 kB each, which are joined on both sides of the shuffle."""
        spots = keys.select(F.explode(self.positions(F.col("key"))).alias("p"))
        # the functions count from 1
        maps = spots.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m"))
        known = {r["k"]: bytes(r["m"]) for r in maps.collect()}  # at most MAX_FILTER_BYTES
        whole = b"".join(known.get(k, bytes(BITMAP // 8)) for k in range(1, -(-self.bits // BITMAP) + 1))
        self.filter = F.lit(whole[: self.bits // 8])

    def holds(self, key: Column) -> Column:
        def is_set(p: Column) -> Column:
            byte = F.ascii(F.decode(F.substring(self.filter, F.floor(p / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            return F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1

        return F.forall(self.positions(key), is_set)


class Cascade:
    """Exact membership of a list within a universe of keys."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: str, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
        """``universe``: distinct ``key`` and the boolean column ``listed``.

        Raises TooLarge if the levels together would be larger than ``max_bytes``.
        """
        sides = {True: universe.where(F.col(listed)).select("key"), False: universe.where(~F.col(listed)).select("key")}
        n_in, n_out = sides[True].count(), sides[False].count()
        if not n_in:
            return cls([])
        levels: list[Level] = []
        inside, n_keys = True, n_in
        while n_keys and len(levels) < MAX_LEVELS:
            rate = min(0.5, max(1e-6, n_in / (n_out + 1) * 0.5**0.5)) if not levels else 0.5
            level = Level.sized(len(levels) + 1, n_keys, rate)
            if sum(x.bits for x in (*levels, level)) > 8 * max_bytes:
                raise TooLarge(f"filters of more than {max_bytes} bytes")
            level.fill(sides[inside])
            levels.append(level)
            inside = not inside  # the other side's keys that this level lets through
            sides[inside] = sides[inside].where(level.holds(F.col("key")))
            n_keys = sides[inside].count()
        if n_keys:
            raise ValueError("the cascade does not end; are keys both listed and unlisted?")
        return cls(levels)

    def size(self) -> int:
        return sum(level.bits for level in self.levels) // 8

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe."""
        verdict: Column = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels, start=1))):
            verdict = F.when(level.holds(key), verdict).otherwise(F.lit(i % 2 == 0))
        return verdict


RULES_SCHEMA = "verdict string, host string, path string"


def _checked(spark: SparkSession, rules: Sequence[Rule] | DataFrame, work: Scratch) -> DataFrame:
    """(key, verdict), each key once; ValueError for rules that cannot be."""
    table = rules.select("verdict", "host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULES_SCHEMA)
    bad = table.where(~F.coalesce(F.col("path").startswith(SEP) & ~F.col("host").contains(SEP) & F.col("verdict").isNotNull(), F.lit(False)))
    if bad.limit(1).collect():
        raise ValueError("a rule has a verdict, its path begins with /, and its host has none")
    keyed = table.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("_other"), F.max(F.length("path")).alias("_length"))
    keyed = work.keep(keyed, "url-rules")
    if both := [r["key"] for r in keyed.where("verdict <> _other").orderBy("key").limit(5).collect()]:
        raise ValueError(f"rules with two verdicts: {both}")
    return keyed.drop("_other")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; a column of such a name is replaced.

    ``rules``: (verdict, host, path), as a list or as a table.  Of the rules that fit, the longest
    (host and path together; ties: longer host) decides; where none fits, ``rule`` is null and
    the verdict ``default``.  A null URL, or one without ``://``, has an empty host and
    path and fits no rule.  Empty tables give empty results; repeated rows stay.

    Where the cascades would take more than ``max_bytes``, the universe is joined with the rules
    and the URLs with the universe, which gives the same rows.
    """
    spark = pages.sparkSession
    out = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    work = Scratch(spark)
    listed = _checked(spark, rules, work)
    # a row per length that a rule's path has, and per verdict
    lengths = sorted(r[0] for r in listed.select("_length").distinct().collect())
    verdicts = sorted(r[0] for r in listed.select("verdict").distinct().collect())
    if not lengths:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    seen = out.select(F.explode(keys).alias("key"), F.lit(None).cast("string").alias("verdict"))
    universe = seen.union(listed.select("key", "verdict")).groupBy("key").agg(F.max("verdict").alias("verdict"))
    universe = work.keep(universe, "url-universe")
    left, cascades = max_bytes, {}
    try:
        for v in verdicts:
            cascades[v] = Cascade.build(universe.withColumn("listed", F.coalesce(F.col("verdict") == v, F.lit(False))), "listed", left)
            left -= cascades[v].size()
    except TooLarge:
        judged = _judge_by_join(out, listed.select("key", "verdict"), lengths, default, work)
        work.drop()
        return judged
    work.drop()  # the filters are in the plan

    def verdict_of(key: Column) -> Column:
        found: Column = F.lit(None).cast("string")
        for v, cascade in cascades.items():
            found = F.when(cascade.holds(key), F.lit(v)).otherwise(found)
        return found

    hits = F.filter(F.transform(F.col("_keys"), lambda k: F.struct(k.alias("key"), verdict_of(k).alias("v"))), lambda x: x["v"].isNotNull())
    out = out.withColumn("_keys", keys).withColumn("_hit", F.get(hits, F.lit(0)))
    return out.withColumns({"rule": F.col("_hit.key"), "verdict": F.coalesce("_hit.v", F.lit(default))}).drop("_keys", "_hit")


def _judge_by_join(out: DataFrame, listed: DataFrame, lengths: Sequence[int], default: str, work: Scratch) -> DataFrame:
    """The way for lists whose filters would be too large to send.

    Each distinct host and path is judged once, so a very common URL is one row of the join.
    """
    parts = out.select("host", "path").distinct()
    asked = parts.select("host", "path", F.posexplode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("_at", "key"))
    # the distinct keys meet the rules, and come back to the parts that asked for them
    known = asked.select("key").distinct().join(listed, "key")
    known = work.keep(known, "url-known")
    found = asked.join(known, "key").groupBy("host", "path").agg(F.min(F.struct("_at", "key", "verdict")).alias("_hit"))
    found = materialize(found, "url-found")
    kept = [c for c in out.columns if c not in ("rule", "verdict")]
    judged = out.select(*kept).join(found, ["host", "path"], "left")
    return judged.select(*kept, F.col("_hit.key").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


#: The rules of the data contract.
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'),
  ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
p AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.page_id = hit.page_id
"""
