"""Search, facets, counts and pages of a catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50, most: int = 200) -> DataFrame:
    """One page in a total order. Sizes are clamped to 1..most and numbers to 1 and more; Spark keeps the top rows only."""
    size = min(max(1, size), most)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def facets(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by ``keys``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """Counts of every value of ``domain``, 0 for those that don't occur."""
    every = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return every.join(facets(df.where(F.col(key).isin(list(domain))), key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def conditional_distinct(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """How many keys have a row that meets each condition.

    Flags are combined per key first, so one shuffle by key serves all conditions and no row is expanded.
    """
    flags = df.groupBy(key).agg(*[F.bool_or(c).alias(n) for n, c in conditions.items()])
    return flags.agg(F.count("*").alias("keys"), *[F.count_if(n).alias(n) for n in conditions])


def in_range(column: Column, low: int | None, high: int | None, least: int, most: int) -> Column:
    """Bounds outside least..most are ignored, as if not given."""
    ok = lambda v: v is not None and least <= v <= most
    return (column >= low if ok(low) else F.lit(True)) & (column <= high if ok(high) else F.lit(True))


def tri_state(column: Column, wanted: bool | None) -> Column:
    """A flag filter: null counts as unset, None filters nothing."""
    return F.lit(True) if wanted is None else F.coalesce(column, F.lit(False)) == F.lit(wanted)
