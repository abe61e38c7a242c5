"""URL filters by a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table

#: Rules of the dealt query, fixed values: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Bits of one filter that are sent to every task (16 MB); a larger list is split into shards by key.
FILTER_BITS = 1 << 27
#: A host is listed if more than this share of its pages, of so many at least, have a query string.
QUERY_SHARE, HOST_PAGES = 0.5, 2
#: A cascade halves what is left at each level, so this is never reached.
LEVELS = 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """Host labels and path lengths of ``rules``, longest rules first; each gives one key a url, whatever the number of rules."""
    size: dict[tuple[int, int], int] = {}
    for _, host, path in rules:
        shape = (host.count(".") + 1, len(path))
        size[shape] = max(size.get(shape, 0), len(host) + len(path))
    return sorted(size, key=lambda s: (-size[s], -s[0], -s[1]))


def rule_key(host: Column, path: Column, shape: tuple[int, int]) -> Column:
    """The key that a rule of ``shape`` fitting this host and path has; null if host or path is too short."""
    labels, length = shape
    enough = (F.length(host) - F.length(F.translate(host, ".", "")) >= labels - 1) & (F.length(path) >= length)
    return F.when(enough, F.concat(F.substring_index(host, ".", -labels), F.substr(path, F.lit(1), F.lit(length))))


def words_for(keys: int, rate: float) -> int:
    """64-bit words of a filter for ``keys`` keys, half as many again as a plain one needs for this rate of false positives."""
    return max(1, math.ceil(1.5 * keys * -math.log(rate) / math.log(2) ** 2 / 64))


class Level:
    """One Bloom filter of a shard, whose keys set all their bits in one 64-bit word: asking it reads a single word.

    The words are a frame of one row; tasks get them by a scalar subquery, so there is no join and one copy an executor.
    """

    def __init__(self, keys: DataFrame, count: int, rate: float, number: int):
        self.number, self.bits = number, max(1, min(8, round(-math.log2(rate))))
        self.size = words_for(count, rate)
        set_bits = keys.select(self._word(F.col("key")).alias("word"), self._mask(F.col("key")).alias("set"))
        none = keys.sparkSession.range(self.size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
        filled = set_bits.unionByName(none).groupBy("word").agg(F.bit_or("set").alias("set"))
        self.words = cut(filled.agg(F.sort_array(F.collect_list(F.struct("word", "set")))["set"].alias("words")))

    def _word(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(f"word {self.number}")), F.lit(self.size))

    def _mask(self, key: Column) -> Column:
        draw, one = F.xxhash64(key, F.lit(f"bits {self.number}")), F.lit(1).cast("long")
        out = F.lit(0).cast("long")
        for i in range(self.bits):
            out = out.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(draw, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
        return out

    def holds(self, key: Column) -> Column:
        mask = self._mask(key)
        return F.element_at(self.words.scalar(), (self._word(key) + 1).cast("int")).bitwiseAND(mask) == mask


class Cascade:
    """Exact membership in a list for every key of a corpus, asked without a join.

    Level 0 encodes the listed keys. Its false positives over the whole key universe are the keys of level 1, the listed
    keys that level 1 holds by mistake those of level 2, and so on until a level makes no mistake. A key is listed if the
    first level that lacks it is an odd one. Keys outside the universe that built it may be judged wrongly; null keys are
    not listed.

    ``listed`` and ``universe`` are frames with a column ``key``; repeats and nulls are dropped, either may be empty. Only
    keys that pass level 0 are shuffled, with their mark by one grouping. A list beyond FILTER_BITS is split into
    shards by hash, a cascade each, so no filter that is sent to the tasks is larger. A level's words are assembled by
    a grouping of its set bits and one array of at most FILTER_BITS / 64 words.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = cut(listed.select("key").where("key IS NOT NULL").distinct())
        keys = universe.select("key").where("key IS NOT NULL")
        count, size = listed.count(), keys.agg(F.approx_count_distinct("key")).first()[0]
        # the estimate only sets the first filter's size, never a result
        rate = min(0.5, max(1 / 256, 0.7 * count / max(1, size)))
        self.shards = math.ceil(words_for(count, rate) / (FILTER_BITS // 64 // 2))
        self.cascades = [self._levels(self._of(listed, s), self._of(keys, s), rate) for s in range(self.shards)]

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards))

    def _of(self, keys: DataFrame, shard: int) -> DataFrame:
        return keys if self.shards == 1 else keys.where(self._shard(F.col("key")) == shard)

    def _levels(self, listed: DataFrame, universe: DataFrame, rate: float) -> list[Level]:
        count = listed.count()
        if not count:
            return []
        levels = [Level(listed, count, rate, 0)]
        passed = universe.where(levels[0].holds(F.col("key"))).select("key", F.lit(False).alias("mark"), F.lit(True).alias("seen"))
        marked = passed.unionByName(listed.select("key", F.lit(True).alias("mark"), F.lit(False).alias("seen")))
        left = cut(marked.groupBy("key").agg(F.max("mark").alias("mark"), F.max("seen").alias("seen")).where("seen").drop("seen"))
        while True:
            odd = len(levels) % 2 == 1
            inside = left.where("NOT mark" if odd else "mark")
            count = inside.count()
            if not count:
                return levels
            if len(levels) == LEVELS:
                raise RuntimeError(f"{count} keys are not told apart by {LEVELS} filters")
            level = Level(inside, count, 0.5, len(levels))
            levels.append(level)
            # the keys just encoded stay for the level after the next; of the others only those held by mistake do
            left = cut(left.where((~F.col("mark") if odd else F.col("mark")) | level.holds(F.col("key"))))

    def lists(self, key: Column) -> Column:
        """Whether ``key`` is listed."""
        out = F.lit(False)
        for shard, levels in enumerate(self.cascades):
            answer = F.lit(len(levels) % 2 == 1)
            for level in reversed(levels):
                answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 1))
            mine = answer if self.shards == 1 else F.when(self._shard(key) == shard, answer).otherwise(False)
            out = mine if self.shards == 1 else out | mine
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], hosts: DataFrame | None = None) -> DataFrame:
    """``pages(url, ...)`` with ``host, path, rule, verdict``: the longest fitting rule's verdict, else block if the host is listed.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with its path. Rules and ``hosts``
    (a frame with a column ``host``) are the keys of one cascade whose universe is every host and every rule-shaped key of
    the pages; a page asks it for each shape of rule, longest first, and for its host, so rules and lists of any size are
    looked up alike, without a join.

    A url that is null or has no ``://`` has an empty host and path and fits no rule; it is allowed. The last of two rules
    with the same host and path counts. Equal urls are judged alike; an empty table gives no rows. Other columns are kept, but
    ones called host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    verdicts = {host + path: verdict for verdict, host, path in rules}
    blocks = [k for k, v in verdicts.items() if v == "block"]
    listed = spark.createDataFrame([(f"rule {k}",) for k in verdicts], "key string")
    if hosts is not None:
        listed = listed.unionByName(hosts.select(F.concat(F.lit("host "), F.col("host")).alias("key")))
    at, path = parts(F.col("url"))
    keys = [F.concat(F.lit("rule "), rule_key(F.col("at"), F.col("path"), s)) for s in shapes(rules)]
    own = F.when(F.col("at") != "", F.concat(F.lit("host "), F.col("at")))
    cascade = Cascade(listed, pages.select(at.alias("at"), path.alias("path")).select(F.explode(F.array(*keys, own)).alias("key")))
    rule = F.coalesce(*(F.when(cascade.lists(k), F.substr(k, F.lit(6))) for k in keys), F.lit(None).cast("string"))
    asked = pages.select(F.struct("*").alias("row"), at.alias("at"), path.alias("path")).select("*", rule.alias("rule"), cascade.lists(own).alias("listed"))
    blocked = F.when(F.col("rule").isNull(), F.col("listed")).otherwise(F.col("rule").isin(blocks) if blocks else F.lit(False))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return asked.select(*kept, F.col("at").alias("host"), "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))


def query_hosts(pages: DataFrame) -> DataFrame:
    """Hosts of HOST_PAGES pages or more of which over QUERY_SHARE have a query string: lists of generated views, not articles.

    Counts are combined before the shuffle, so a hot host costs no more than others.
    """
    seen = pages.select(parts(F.col("url"))[0].alias("host"), F.col("url").contains("?").cast("int").alias("query")).where("host <> ''")
    return seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("query").alias("q")).where((F.col("n") >= HOST_PAGES) & (F.col("q") > QUERY_SHARE * F.col("n"))).select("host")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the stated rules; hosts of mostly generated views are listed and blocked where no rule fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, RULES, query_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
fit AS (
  SELECT s.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY 1
),
listed AS (SELECT host FROM split WHERE host <> '' GROUP BY host HAVING count(*) >= {HOST_PAGES} AND count(*) FILTER (contains(url, '?')) > {QUERY_SHARE} * count(*))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN l.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split s LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON l.host = s.host
"""
