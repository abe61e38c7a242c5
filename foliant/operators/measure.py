"""Statistics of measurements: frontiers, group figures, outliers, completeness, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pareto(points: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Points that no other of their group beats at larger (or equal) x and smaller (or equal) y; equal points all stay.

    Groups of fewer than ``least`` usable points (both numbers finite and positive) give none. Rows are reduced to the
    least y of each x first, and only these are swept; the points come back by a join.
    """
    fine = points.where((F.col(x) > 0) & (F.col(y) > 0) & (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf")))
    steps = fine.groupBy(*keys, x).agg(F.min(y).alias("_low"), F.count("*").alias("_n"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_beyond", F.min("_low").over(beyond)).withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys)))
    front = steps.where((F.col("_size") >= least) & (F.col("_beyond").isNull() | (F.col("_low") < F.col("_beyond"))))
    return fine.join(front.select(*keys, x, F.col("_low").alias(y)), [*keys, x, y], "left_semi")


def group_figures(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("high"))


def robust_outliers(rows: DataFrame, keys: Sequence[str], value: Column, least: int = 8, bound: float = 3.5) -> DataFrame:
    """``rows`` plus ``z``, the modified z-score by median and MAD, for outliers of groups with ``least`` rows and a MAD over 0."""
    r = rows.withColumn("_v", value)
    middle = r.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5)).alias("_med"), F.count("_v").alias("_n")).where(F.col("_n") >= least)
    r = r.join(middle, list(keys))
    spread = r.groupBy(*keys).agg(F.percentile(F.abs(F.col("_v") - F.col("_med")), F.lit(0.5)).alias("_mad")).where("_mad > 0")
    z = 0.6745 * (F.col("_v") - F.col("_med")) / F.col("_mad")
    return r.join(spread, list(keys)).withColumn("z", z).where(F.abs("z") > bound).drop("_v", "_med", "_n", "_mad")


def completeness(rows: DataFrame, key: str, fields: Mapping[str, Column], inferred: Column) -> DataFrame:
    """Per key and field 0 (missing), 1 (inferred only) or 2 (measured), and a status by all fields."""
    state = lambda c: F.max(F.when(c & inferred, 1).when(c, 2).otherwise(0)).alias
    found = rows.groupBy(key).agg(*[state(c)(n) for n, c in fields.items()])
    low, high = F.least(*fields), F.greatest(*fields)
    return found.withColumn("status", F.when(low == 2, "complete").when(low == 1, "inferred").when(high > 0, "partial").otherwise("metadata_only"))


def drop_gate(counts: DataFrame, key: str, now: str, usual: str, ratio: float = 0.7) -> DataFrame:
    """``ok`` is false where a count is 0 or under ``ratio`` of the usual one."""
    return counts.withColumn("ok", (F.col(now) > 0) & (F.col(now) >= ratio * F.coalesce(F.col(usual), F.lit(0))))


def recent_mean(runs: DataFrame, key: str, order: Column, value: str, most: int = 5) -> DataFrame:
    """Mean of each key's last ``most`` runs."""
    last = runs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most)
    return last.groupBy(key).agg(F.avg(value).alias("usual"), F.count("*").alias("runs"))
