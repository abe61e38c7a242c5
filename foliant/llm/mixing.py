"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Beyond so many sources the rates are joined by a shuffle instead of a broadcast (50 bytes a source).
BROADCAST_SOURCES = 50_000
#: Longest table of the distribution; a rate above RATE_STEP is drawn as whole copies plus a Poisson rest.
RATE_STEP, TERMS = 8.0, 48
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and ``parts``: 52 bits, the same on every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches ``u``; rates up to RATE_STEP."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u > F.exp(-rate), 1).otherwise(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["k"] + F.when(u > c, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, power: float = 0.5) -> DataFrame:
    """Rows ``source, n, rate``: how often a document of each source is to be repeated on average.

    A source's share of the output is its weight over all weights; sources without one get 0 if ``weights`` is
    given, and all get n^power if not. ``rows`` is the expected size of the output, that of the input if None.
    Null is a source of its own. The counts are map-side combined, so a hot source costs no more than others.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        n = n.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)).cast("double") if weights else F.lit(0.0))
    n = cut(n)
    total, weight = n.agg(F.sum("n"), F.sum("weight")).first()
    return n.select("source", "n", (F.lit(float(rows if rows is not None else total or 0)) * F.col("weight") / F.lit(weight or 1.0) / F.col("n")).alias("rate"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, power: float = 0.5) -> DataFrame:
    """Rows ``row, copy, rate``: every row of ``docs`` (as a struct) repeated by a Poisson draw of its source's rate, in
    random global order; ``copy`` counts from 0.

    The draw hangs on doc_id and source; for a row without a doc_id on its source and whole text instead. A rerun
    repeats it, and repeated rows share it. Rows whose draw is 0 are left out, which is the method. An empty table
    gives no rows. Columns of any name may come along, as they stay inside ``row``. Only (source, rate) meets the
    documents, by broadcast when there are few sources; beyond that rows are joined on (source, salt), so a hot source
    is spread.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text)))
    own = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), name.alias("name"))
    r = rates(own, weights, rows, power).select(F.col("source").alias("of"), "rate")
    if r.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(r), F.col("source").eqNullSafe(F.col("of")))
    else:
        salts = 64
        r = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).join(r, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    ident = [F.col("name"), F.coalesce(F.col("source"), F.lit(""))]
    whole = F.floor(F.col("rate") / RATE_STEP).cast("int")
    rest = F.col("rate") - whole * RATE_STEP
    # a sum of Poisson draws is a Poisson draw of the summed rate
    steps = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    k = poisson(uniform(F.lit("n"), *ident), rest) + F.aggregate(
        steps, F.lit(0), lambda s, i: s + poisson(uniform(F.concat(F.lit("n"), i.cast("string")), *ident), F.lit(RATE_STEP)))
    repeated = joined.withColumn("n", k).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ordered = repeated.select("row", "copy", "rate", uniform(F.lit("o"), *ident, F.col("copy")).alias("order"))
    return ordered.repartition("order").sortWithinPartitions("order").drop("order")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, power: float = 0.5) -> DataFrame:
    """``docs`` with its rows repeated (see ``mixed``), same columns."""
    return mixed(docs, weights, rows, power).select("row.*")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as the draw says: its columns, copy and rate (6 places).

    Sources are weighted by the square root of their documents; the output is as large as the input.
    """
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select(*(F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "lang", "n_chars", "text")), "copy", F.round("rate", 6).alias("rate"))


OP4_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
d AS (
  SELECT t.*, r.rate, floor(r.rate / {RATE_STEP})::INT AS whole, r.rate - floor(r.rate / {RATE_STEP}) * {RATE_STEP} AS rest
  FROM documents t JOIN r ON t.source IS NOT DISTINCT FROM r.source
),
draws AS (
  SELECT d.*, i, CASE WHEN i = 0 THEN rest ELSE {RATE_STEP} END AS lam,
    (('0x' || substr(md5('{SEED}:n' || CASE WHEN i = 0 THEN '' ELSE i::VARCHAR END || ':' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) || ':' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d, unnest(range(0, whole + 1)) AS x(i)
),
k AS (
  SELECT doc_id, source, lang, n_chars, text, rate,
    (SELECT count(*) FROM unnest(range(0, {TERMS + 1})) AS y(j)
     WHERE u > list_reduce(list_prepend(0.0::DOUBLE, [exp(-lam) * list_reduce(list_prepend(1.0::DOUBLE, [lam / z FOR z IN range(1, m + 1)]), lambda a, b: a * b) FOR m IN range(0, j + 1)]), lambda a, b: a + b)) AS n
  FROM draws
),
total AS (SELECT doc_id, source, lang, n_chars, text, rate, sum(n)::INT AS n FROM k GROUP BY ALL)
SELECT doc_id, source, lang, n_chars, text, c::INT AS copy, round(rate, 6) AS rate FROM total, unnest(range(0, n)) AS x(c)
"""
