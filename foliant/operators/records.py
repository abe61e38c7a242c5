"""Records beside each other: fallbacks by rank, overlays, patches, bounded pairs, merges, mirrors and checks of imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Place of ``value`` in ``order`` from 0; values that it lacks, and null, come last."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(value == name, i).otherwise(rank)
    return rank


def first_filled(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """The first value a key that isn't null, by ``order``; an aggregate, so a hot key is combined map-side."""
    filled = rows.where(F.col(value).isNotNull())
    return filled.groupBy(*keys).agg(F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(value))


def best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole row of each key that comes first by the tuple ``order``."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")).select("r.*")


def populated(*columns: str) -> Column:
    """How many of ``columns`` hold something."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def overlay(nodes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``nodes`` with the columns of the row whose ``key`` agrees without regard to case and outer spaces, null if none does."""
    name = lambda c: F.lower(F.trim(c))
    own = rows.withColumnRenamed(key, "other").where(F.col("other").isNotNull())
    return nodes.join(own, name(F.col(key)) == name(F.col("other")), "left").drop("other")


def patch(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``target`` with ``columns`` taken from ``changes`` where that has a row and a value."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    both = target.join(new, key, "left")
    return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def pairs_of_selection(rows: DataFrame, group: Sequence[str], ident: str, order: Sequence[Column], most: int) -> DataFrame:
    """All pairs of the ``most`` first rows of each group: the selection is bounded, so its pairs are too."""
    few = rows.withColumn("n_", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n_") <= most)
    a, b = (few.select(*group, F.col(ident).alias(x)) for x in "ab")
    return a.join(b, list(group)).where("a < b")


def representative(rows: DataFrame, keys: Sequence[str], canonical: Column, ident: str) -> DataFrame:
    """The smallest id among canonical rows of a key, among all if none is."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(canonical, F.col(ident))), F.min(ident)).alias("representative"))


def best_with_margin(pairs: DataFrame, left: str, right: str, score: str, least: float = 0.94, margin: float = 0.025) -> DataFrame:
    """``left, right, score, verdict``: matched if the best score is high enough and far enough from the second."""
    order = Window.partitionBy(left).orderBy(F.desc(score), right)
    two = pairs.select(left, right, score, F.row_number().over(order).alias("n_")).where("n_ <= 2")
    top = two.groupBy(left).agg(F.min_by(right, "n_").alias(right), F.max(score).alias(score), F.min(F.when(F.col("n_") == 2, F.col(score))).alias("second_"))
    verdict = F.when(F.col(score) < least, "unmatched").when(F.col(score) - F.coalesce("second_", F.lit(0.0)) < margin, "ambiguous").otherwise("matched")
    return top.select(left, right, score, verdict.alias("verdict"))


def merge_candidates(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row a key of all ``sets`` (name to frame with the key), with the sorted names of those that have it."""
    parts = [frame.select(key, F.lit(name).alias("name_")) for name, frame in sorted(sets.items())]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    return all_rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name_")), "+").alias("found_in"))


def neighbours(edges: DataFrame, seed: str, node: str, weight: str, most: int) -> DataFrame:
    """The ``most`` - 1 heaviest neighbours of each seed with a positive weight, ties to the smaller node."""
    order = Window.partitionBy(seed).orderBy(F.desc(weight), node)
    return edges.where(F.col(weight) > 0).withColumn("place", F.row_number().over(order)).where(F.col("place") < most)


def directed_edges(references: DataFrame, shown: DataFrame, citing: str, cited: str, node: str) -> DataFrame:
    """Distinct edges cited to citing whose ends are both among the ``shown`` nodes."""
    for end in (citing, cited):
        references = references.join(shown.select(F.col(node).alias(end)).distinct(), end, "left_semi")
    return references.where(F.col(citing) != F.col(cited)).select(F.col(cited).alias("start"), F.col(citing).alias("end")).distinct()


def quarantine(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` that stay and rows set aside; a null verdict stays."""
    set_aside = F.coalesce(bad, F.lit(False))
    return rows.where(~set_aside), rows.where(set_aside)


def mirror_plan(source: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """``key, action``: what makes ``mirror`` hold exactly the keys of ``source``."""
    a, b = source.select(F.col(key).alias("a")).distinct(), mirror.select(F.col(key).alias("b")).distinct()
    action = F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "remove").otherwise("keep")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), action.alias("action"))


def checked_filters(filters: Mapping[str, object], allowed: Sequence[str]) -> Column:
    """Equality filters as one condition; names outside ``allowed`` are an error, an empty value filters nothing."""
    unknown = sorted(set(filters) - set(allowed))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    condition = F.lit(True)
    for name, value in sorted(filters.items()):
        if value not in (None, ""):
            condition = condition & (F.col(name) == F.lit(value))
    return condition
