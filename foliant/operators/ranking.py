"""One, some or all rows of a group in a stated order; interleaving, quotas, samples and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, where: Column | None = None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key among those that meet ``where``: the predicate is applied before ranking, so no
    value comes from one row and its condition from another. The limit is applied in each partition before the shuffle."""
    kept = rows if where is None else rows.where(where)
    ranked = kept.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(rank or "_rank") <= n)
    return ranked if rank else ranked.drop("_rank")


def best(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """``columns`` of each key's greatest row by the tuple ``rank``. An aggregate, so a hot key is combined map-side."""
    kept = rows if where is None else rows.where(where)
    found = kept.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("_best"))
    return found.select(*keys, "_best.*")


def weighted_interleave(rows: DataFrame, group: str, order: Sequence[Column], head: Column, limit: int) -> DataFrame:
    """Rows in the order of always taking from the group with the least share taken so far; then higher head, then name."""
    window = Window.partitionBy(group)
    shared = rows.withColumn("_n", F.row_number().over(window.orderBy(*order)))
    counts = rows.groupBy(group).agg(F.count("*").alias("_of"))
    turn = (F.col("_n") - 1) / F.col("_of")
    return shared.where(F.col("_n") <= limit).join(counts, group).withColumn("turn", turn).orderBy("turn", head.desc(), group).limit(limit).drop("_n", "_of")


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Rows taken one from each group in turn, larger groups first."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= limit)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_of"))
    return ranked.join(sizes, group).orderBy("turn", F.desc("_of"), group).limit(limit).drop("_of")


def capped(rows: DataFrame, group: str, order: Sequence[Column], each: int, total: int) -> DataFrame:
    """At most ``each`` rows of a group and ``total`` of all, in one order."""
    return top(rows, [group], order, each).orderBy(*order).limit(total)


def largest_remainder(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Whole quotas in proportion to ``n`` that sum to ``total``; remainders by size, then name. ``counts`` has a row a group."""
    exact = F.lit(total) * F.col(n) / F.sum(n).over(Window.partitionBy(F.lit(0)))
    shares = counts.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("_rest", 9)), key))
    return shares.withColumn("_left", left).withColumn("_rank", rank).select(key, n, (F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def hash_sample(rows: DataFrame, stratum: str, ident: str, quota: int, seed: str) -> DataFrame:
    """``quota`` rows a stratum, those whose seeded hash is lowest: reruns and input order don't change it."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(ident).cast("string")))
    return top(rows.withColumn("_hash", key), [stratum], [F.col("_hash"), F.col(ident)], quota).drop("_hash")


def sequence(rows: DataFrame, lead: Sequence[str], order: Sequence[Column], name: str = "sequence") -> DataFrame:
    """A running number over all rows by (lead, order). Only the groups' counts meet in one task; rows are ranked within
    ``lead``, so choose it such that a group can be sorted by one."""
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*lead).orderBy(*order)))
    counts = rows.groupBy(*lead).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(*lead)) - F.col("_n")).drop("_n")
    return own.join(before, list(lead)).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own")


def batches(rows: DataFrame, size: int, number: str = "sequence") -> DataFrame:
    place = F.col(number) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long") + 1).withColumn("item", (place % size).cast("long") + 1)
