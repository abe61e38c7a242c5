"""Joins with the catalogue's precedence and one-row rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_override(base: DataFrame, override: DataFrame, key: str, column: str, active: Column, default: str) -> DataFrame:
    """``base`` with ``column`` from active rows of ``override`` first, from ``base`` next, ``default`` last."""
    live = override.where(active).select(key, F.col(column).alias("_override"))
    return base.join(live, key, "left").withColumn(column, F.coalesce("_override", column, F.lit(default))).drop("_override")


def first_by(rows: DataFrame, keys: Sequence[str], order: Column, **columns: str) -> DataFrame:
    """For each key, ``columns`` (alias = name) of its first row by ``order``, combined before the shuffle."""
    best = F.min_by(F.struct(*[F.col(c).alias(a) for a, c in columns.items()]), order)
    return rows.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")


def latest(runs: DataFrame, group: str, order: str, complete: Column) -> DataFrame:
    """The latest complete run of every group."""
    return runs.where(complete).groupBy(group).agg(F.max(order).alias(order))


def same_row(base: DataFrame, points: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """Rows of ``base`` with one point that meets all conditions at once."""
    met = points
    for c in conditions:
        met = met.where(c)
    return base.join(met.select(key).distinct(), key, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """Full outer comparison: every key with status only_left, only_right, equal or changed."""
    a = left.select(key, F.struct(*compare).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(key, F.struct(*compare).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right")
    return a.join(b, key, "full_outer").select(key, status.when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("changed").alias("status"))
