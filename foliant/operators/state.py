"""Sessions, rolling counts, daily picks and expiring entries over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Rows ``user, start, end, n``: runs of events with no pause of ``gap`` or more."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("last")).drop("w")


def rollup(events: DataFrame, user: str, ts: str, now: Column, online_seconds: int = 300, idle_seconds: int = 86400) -> DataFrame:
    """First and last event, their count and a status by the last one's age."""
    seen = events.groupBy(user).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("observed"))
    age = F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return seen.withColumn("status", F.when(age <= online_seconds * 1_000_000, "online").when(age <= idle_seconds * 1_000_000, "idle").otherwise("offline"))


def rolling_count(events: DataFrame, user: str, ts: str, seconds: int = 86400) -> DataFrame:
    """``events`` plus ``recent``: how many of the user's events fall in the ``seconds`` up to and with each."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(at).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("recent", F.count("*").over(w))


def daily_pick(rows: DataFrame, owner: str, day: str, ident: str, n: int = 2, seed: str = "pick") -> DataFrame:
    """``n`` rows an owner and day by seeded hash, the same on every run."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(day).cast("string"), F.col(ident).cast("string")))
    w = Window.partitionBy(owner, day).orderBy(key, ident)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def live(entries: DataFrame, expires: str, now: Column) -> DataFrame:
    return entries.where(F.col(expires) > now)


def versioned_update(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Optimistic updates ``key, version, value``: applied where the version is the current one, else conflict."""
    now = current.select(key, F.col("version").alias("_version"))
    r = updates.join(now, key, "left")
    outcome = F.when(F.col("_version").isNull(), "missing").when(F.col("_version") == F.col("version"), "applied").otherwise("conflict")
    return r.select(key, "version", outcome.alias("outcome"))
