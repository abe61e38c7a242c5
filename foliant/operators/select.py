"""Lists for readers: mode scores, novelty, diverse selection, batches under two limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recency(age: Column, step: float = 0.08) -> Column:
    return F.greatest(F.lit(0.0), 1 - step * age)


def mode_score(mode: str, match: Column, novelty: Column, fresh: Column) -> Column:
    """0..100 by reading mode: explore weighs novelty .35, recent weighs freshness .45, others match alone."""
    mixes = {"explore": 0.65 * match + 0.35 * novelty, "recent": 0.55 * match + 0.45 * fresh}
    return F.round(mixes.get(mode, match), 6)


def novelty(rows: DataFrame, topic: str) -> DataFrame:
    """``topic, n, novelty``: 100 for topics without rows, 0 for the one with most."""
    n = rows.groupBy(topic).agg(F.count("*").alias("n"))
    return n.withColumn("novelty", F.round(100 * (1 - F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0)))), 6))


def diverse(candidates: DataFrame, limit: int, pool: int = 6000) -> DataFrame:
    """``limit`` rows of ``candidates(id, score, topic, venue, terms)``, one after the other: each time the one with the highest
    score less 12 a row of its topic taken so far, 4 a row of its venue, 25 times its largest overlap with a row taken.

    Each choice hangs on those before it, so this runs in one task, over the ``pool`` best rows: the size of a reader's
    candidate list, which is part of the rule and not of the data.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
        terms = {r["id"]: set(r["terms"]) for r in left}
        most = dict.fromkeys(terms, 0.0)
        topics: dict = {}
        venues: dict = {}
        out = []
        while left and len(out) < limit:
            worth = lambda r: r["score"] - 12 * topics.get(r["topic"], 0) - 4 * venues.get(r["venue"], 0) - 25 * most[r["id"]]
            best = max(left, key=lambda r: (worth(r), -r["id"]))
            out.append({"place": len(out) + 1, "id": best["id"], "value": round(worth(best), 6)})
            left.remove(best)
            topics[best["topic"]] = topics.get(best["topic"], 0) + 1
            venues[best["venue"]] = venues.get(best["venue"], 0) + 1
            own = terms[best["id"]]
            for r in left:
                both = len(own & terms[r["id"]])
                union = len(own) + len(terms[r["id"]]) - both
                most[r["id"]] = max(most[r["id"]], both / union if union else 0.0)
        return pd.DataFrame(out, columns=["place", "id", "value"]).astype({"place": "int32", "id": "int64", "value": "float64"})

    few = candidates.orderBy(F.desc("score"), "id").limit(pool).withColumn("_all", F.lit(0))
    return few.groupBy("_all").applyInPandas(choose, "place int, id long, value double")


def bounded_batches(rows: DataFrame, group: str, order: list[str], ident: str, size: str, most: int = 5, room: int = 6000) -> DataFrame:
    """``group, ident, batch``: rows in order, a new batch where the next row is one too many or doesn't fit (a row larger
    than a batch has one for itself). Rows stream through sorted partitions; a task holds counters and no group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, n, used = None, 0, 0, 0
        for part in batches:
            number = []
            for g, s in zip(part[group], part[size]):
                if g != now:
                    now, batch, n, used = g, 1, 0, 0
                elif n == most or used + s > room:
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + s
                number.append(batch)
            yield pd.DataFrame({group: part[group], ident: part[ident], "batch": pd.array(number, dtype="int64")})

    kinds = dict(rows.dtypes)
    kept = rows.select(group, ident, size, *[o for o in order if o not in (group, ident, size)])
    return kept.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, f"{group} {kinds[group]}, {ident} {kinds[ident]}, batch long")
