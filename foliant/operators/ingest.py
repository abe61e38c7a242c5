"""Batches into snapshots: upserts, prunes, ownership, planned changes, reports of differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first by ``order``: a later file wins over an earlier one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, replace: Sequence[str] = (), keep: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """The snapshot after a batch. ``replace`` takes the new value unless it is null or blank, ``keep`` the old one unless
    that is, ``most`` the greater. Rows of either side alone stay."""
    a, b = old.alias("a"), new.alias("b")
    filled = lambda c: F.when(F.trim(c.cast("string")).isin("", "N/A"), None).otherwise(c)
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    one = lambda s, c: F.col(f"{s}.{c}")
    return both.select(
        F.coalesce(one("a", key), one("b", key)).alias(key),
        *[F.coalesce(filled(one("b", c)), one("a", c)).alias(c) for c in replace],
        *[F.coalesce(filled(one("a", c)), one("b", c)).alias(c) for c in keep],
        *[F.greatest(one("a", c), one("b", c)).alias(c) for c in most])


def missing(present: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``present`` lacks; empty after a whole import, the rows to delete in a mirror."""
    return wanted.select(key).distinct().join(present, key, "left_anti")


def contested(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner claims."""
    return rows.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first"), F.max(owner).alias("last")).where("owners > 1")


def unique_only(rows: DataFrame, key: str, target: str) -> DataFrame:
    """key to target where the key has one target only."""
    return rows.groupBy(key).agg(F.min(target).alias(target), F.count_distinct(target).alias("_n")).where("_n = 1").drop("_n")


def plan_changes(proposals: DataFrame, current: DataFrame, key: str, field: str) -> DataFrame:
    """A verdict for each proposal ``key, expected, proposed`` against ``current(key, field)``.

    missing_row, already_applied, stale (the field isn't what was expected), preserved (a value would become blank),
    collision (a value is proposed for several keys or another key has it), else accept.
    """
    shared = proposals.groupBy("proposed").agg(F.count_distinct(key).alias("_keys")).where("_keys > 1").select("proposed", F.lit(True).alias("_shared"))
    taken = current.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("proposed")).agg(F.min(key).alias("_owner"), F.max(key).alias("_owner2"))
    r = proposals.join(current.select(F.col(key), F.col(field).alias("_now"), F.lit(True).alias("_there")), key, "left").join(shared, "proposed", "left").join(taken, "proposed", "left")
    other = F.col("_owner").isNotNull() & ((F.col("_owner") != F.col(key)) | (F.col("_owner2") != F.col(key)))
    verdict = (
        F.when(F.col("_there").isNull(), "missing_row").when(F.col("_now").eqNullSafe(F.col("proposed")), "already_applied")
        .when(~F.col("_now").eqNullSafe(F.col("expected")), "stale").when(F.col("proposed").isNull(), "preserved")
        .when(F.col("_shared") | other, "collision").otherwise("accept"))
    return r.select(key, "expected", "proposed", verdict.alias("verdict"))


def fingerprint(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A digest of each row's protected fields."""
    return rows.select(key, F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields]), 256).alias("digest"))
