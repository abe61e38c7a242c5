"""Importance resampling towards a target distribution of hashed word runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table
from .conversations import CRC_SQL, crc_sql

#: All but ASCII digits, lower-case letters and characters beyond ASCII; A-Z is lower-cased before.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, RUN = 10_000, 1
#: Words that start in one chunk of a long text.
CHUNK = 4096
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 10, "2024"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), APART), "")


def chunks(texts: DataFrame, run: int = RUN, size: int = CHUNK) -> DataFrame:
    """``texts(text, ...)`` cut at word boundaries: other columns, ``chunk`` from 0, ``own`` and ``words``.

    A chunk owns the ``own`` <= ``size`` positions at which its runs start and carries the run - 1 words after them, so
    every run of up to ``run`` words lies in exactly one chunk that owns its start. A text without words is one chunk
    of none. A row after this holds a bounded number of words, however long its text was.
    """
    split = texts.withColumn("words", words(F.col("text"))).drop("text")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(size))
    cuts = F.transform(starts, lambda i: F.struct((i / size).cast("int").alias("chunk"), F.least(F.size("words") - i, F.lit(size)).alias("own"), F.slice("words", i + 1, size + run - 1).alias("words")))
    return split.withColumn("cut", F.explode(cuts)).drop("words").select("*", "cut.*").drop("cut")


def features(run: int = RUN, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``run`` words that start in a chunk, repeats included."""
    hashed = lambda gram: (F.crc32(gram.cast("binary")) % buckets).cast("int")
    found = [F.transform(F.slice("words", 1, F.col("own")) if run > 1 else F.col("words"), hashed)]

    def runs(n: int) -> Column:
        # shorter at the text's end, where no carried words follow
        last = F.least(F.col("own"), F.size("words") - n + 1)
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: hashed(F.array_join(F.slice("words", i, n), " ")))

    found += [runs(n) for n in range(2, run + 1)]
    return F.concat(*found) if run > 1 else found[0]


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``bucket, n`` over all texts: at most ``buckets`` of them, combined before the shuffle."""
    return chunks(texts.select("text"), run).select(F.explode(features(run, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(raw: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of each bucket's share in ``target`` over that in ``raw``, both with one added to every bucket.

    The counts of all texts; only ``buckets`` of them come to the driver.
    """
    s, t = (dict(map(tuple, bucket_counts(x, run, buckets).collect())) for x in (raw, target))
    all_s, all_t = (float(sum(x.values()) + buckets) for x in (s, t))
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(buckets)]


def weighted(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """Rows ``doc_id, n_features, n_words, weight``, one per row of ``docs(doc_id, text, ...)``.

    Texts are cut into chunks; each chunk's runs are counted and their gains summed, and the sums are added by document,
    map-side first. A document is its doc_id and text: repeated rows come as one with a number of copies and are given back as
    that many. The gains (one long a bucket) go to the tasks with the plan.
    """
    gain = F.split(F.lit(",".join(map(str, gains(docs, target, run, buckets)))), ",").cast("array<long>")
    own = docs.select("doc_id", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"))
    cut_up = chunks(own, run).select("doc_id", "digest", "chunk", "own", features(run, buckets).alias("found"))
    each = cut_up.select(
        "doc_id", "digest", (F.col("chunk") == 0).cast("long").alias("first"), F.col("own").cast("long").alias("n_words"), F.size("found").cast("long").alias("n_features"),
        F.aggregate("found", F.lit(0).cast("long"), lambda total, b: total + gain[b]).alias("weight"))
    sums = each.groupBy("doc_id", "digest").agg(*(F.sum(c).alias(c) for c in ("first", "n_words", "n_features", "weight")))
    one = [F.expr(f"{c} div first").alias(c) for c in ("n_features", "n_words", "weight")]
    return sums.select("doc_id", *one, F.explode(F.sequence(F.lit(1).cast("long"), F.col("first")))).drop("col")


def drawn(weights: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``weights`` with ``score`` and ``rank``: the ``percent`` per cent with the highest Gumbel-perturbed weights, without replacement.

    The noise hangs on the seed and doc_id alone (a null one hashes as empty). Rows are sorted globally by range partitions; a
    row's rank is its place in its partition plus the sizes of the partitions before, so no task sees more than its range.
    """
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    able = F.col("n_words") >= least_words
    scored = weights.withColumn("score", F.col("weight") + noise).withColumn("able", able)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["part"]], total = total, total + r["n"]
    wanted = percent * sum(r["able"] for r in sizes) // 100
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[part] if before else F.lit(0)
    rank = (offset + place + 1).cast("long")
    return placed.withColumn("rank", F.when(F.col("able") & (rank <= wanted), rank)).drop("able", "at")


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, run: int = RUN) -> DataFrame:
    """Rows ``doc_id, n_features, n_words, weight, score, rank``, one per row of ``docs(doc_id, text, ...)``; ``target(text)``.

    Null and empty texts have no features and weight 0 and are never drawn. Null doc_ids come last among ties. Repeated rows
    have a result each. An empty target or table of documents is allowed. Other columns are ignored.
    """
    return drawn(weighted(docs, target, run), percent)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
counted AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT unnest(w) AS word, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY word),
hashed AS MATERIALIZED (SELECT word, s, counted.t AS n, {crc_sql("word")} % {BUCKETS} AS bucket FROM counted, tab),
sums AS (SELECT bucket, sum(s) AS s, sum(n) AS t FROM hashed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM sums
),
per AS (SELECT k, sum(g)::BIGINT AS weight FROM (SELECT k, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN per USING (k)
),
ranked AS (SELECT *, n_features >= {LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {DRAWN_PERCENT} * (SELECT count(*) FILTER (able) FROM ranked) // 100 THEN r END AS rank FROM ranked
"""
