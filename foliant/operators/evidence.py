"""Evidence of figures: which rate a power may be divided by, and which statements of both belong together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reviews that rule a statement out, sources whose rows are curated as a whole, fields that a rate may be stated as.
REFUSED = ("rejected", "invalid", "needs_review")
CURATED = ("user_sheet", "reference_xlsx")
RATE_FIELDS = {
    "reported_rate_gbps": ("reported_rate_gbps", "lane_rate_gbps", "aggregate_rate_gbps"),
    "lane_rate_gbps": ("lane_rate_gbps", "reported_rate_gbps"),
    "aggregate_rate_gbps": ("aggregate_rate_gbps", "reported_rate_gbps", "lane_rate_gbps"),
}
BASE = np.uint64(0x9E3779B97F4A7C15)


def longest_common(a: str, b: str) -> int:
    """Length of the longest substring of both, in n log² n: doubled, then halved window lengths, compared by sorted hashes.

    Equal hashes are checked on the signs, so a collision can't lengthen the answer.
    """
    if not a or not b:
        return 0
    codes = [np.frombuffer(x.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1) for x in (a, b)]
    longest = max(map(len, codes))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(longest, BASE, dtype=np.uint64)]))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(c * powers[: len(c)], dtype=np.uint64)]) for c in codes]

    def shared(length: int) -> bool:
        # windows of both are brought to the power of the longer text
        x, y = ((s[length:] - s[: len(c) - length + 1]) * powers[longest - np.arange(len(c) - length + 1)] for c, s in zip(codes, sums))
        order = np.argsort(y, kind="stable")
        at = np.searchsorted(y[order], x)
        inside = at < len(y)
        for i in np.flatnonzero(inside)[y[order[at[inside]]] == x[inside]].tolist():
            for j in order[at[i] :].tolist():
                if y[j] != x[i]:
                    break
                if a[i : i + length] == b[j : j + length]:
                    return True
        return False

    least, most = 0, min(map(len, codes))
    step = 1
    while least + step <= most and shared(least + step):
        least, step = least + step, step * 2
    most = min(most, least + step - 1)
    while least < most:
        middle = (least + most + 1) // 2
        least, most = (middle, most) if shared(middle) else (least, middle - 1)
    return least


def longest_overlap(a: Column, b: Column) -> Column:
    """Signs of the longest run that both texts have; 0 for null and empty ones."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([longest_common(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run(a, b)


def folded(text: Column) -> Column:
    """Lower case, white space as one space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def rate_choice(rates: Mapping[str, Column], power_scope: Column, curated: Sequence[str] = CURATED) -> Column:
    """A struct ``eligible, field, value, reason``: the rate that a power of this scope (lane, aggregate, unknown) may be divided by.

    ``rates`` has reported, lane, aggregate, least, greatest (of a range), lanes, scope and source. Curated rows divide by the first rate
    they have. A range is no operating point. Several lanes need a power whose scope is known, and totals and lanes are never mixed. A rate
    of zero counts as missing where another one can stand in for it.
    """
    reported, lane, aggregate = (rates[k].cast("double") for k in ("reported", "lane", "aggregate"))
    scope, source = folded(rates["scope"]), folded(rates["source"])
    power_scope = F.coalesce(power_scope, F.lit("unknown"))

    def answer(field: str | Column | None, value: Column, reason: str) -> Column:
        name = F.lit(field) if not isinstance(field, Column) else field
        return F.struct(value.isNotNull().alias("eligible"), F.when(value.isNotNull(), name.cast("string")).alias("field"), value.alias("value"), F.lit(reason).alias("reason"))

    nothing = F.lit(None).cast("double")
    no = lambda reason: answer(None, nothing, reason)
    either = lambda first, name: (F.coalesce(F.nullif(first, F.lit(0.0)), reported), F.when(first.isNotNull(), name).otherwise("reported_rate_gbps"))
    total, total_field = either(aggregate, "aggregate_rate_gbps")
    single, single_field = either(lane, "lane_rate_gbps")
    first = F.when(reported.isNotNull(), "reported_rate_gbps").when(lane.isNotNull(), "lane_rate_gbps").otherwise("aggregate_rate_gbps")
    value = F.coalesce(reported, lane, aggregate)
    many, of_lane, of_all = F.coalesce(rates["lanes"].cast("double") > 1, F.lit(False)), power_scope == "lane", power_scope == "aggregate"
    rungs = (
        (source.isin(list(curated)) & value.isNotNull(), answer(first, value, "spreadsheet_speed_column")),
        (source.isin(list(curated)), no("missing_fixed_bit_rate")),
        (rates["least"].isNotNull() | rates["greatest"].isNotNull(), no("rate_range_without_operating_point")),
        ((scope == "aggregate") & total.isNotNull(), answer(total_field, total, "explicit_aggregate_rate")),
        (scope == "aggregate", no("missing_aggregate_rate")),
        (many & of_lane & single.isNotNull(), answer(single_field, single, "per_lane_power")),
        (many & of_lane, no("missing_lane_rate")),
        (many & of_all & aggregate.isNotNull(), answer("aggregate_rate_gbps", aggregate, "total_power_multilane")),
        (many & of_all, no("missing_aggregate_rate")),
        (many, no("multilane_power_scope_unknown")),
        ((of_lane | (scope == "lane")) & single.isNotNull(), answer(single_field, single, "single_lane_rate")),
        (of_lane | (scope == "lane"), no("missing_lane_rate")),
        (of_all & aggregate.isNotNull(), answer("aggregate_rate_gbps", aggregate, "explicit_total_power")),
        (reported.isNotNull(), answer("reported_rate_gbps", reported, "single_reported_rate")),
        (lane.isNotNull(), answer("lane_rate_gbps", lane, "single_lane_rate")),
        (aggregate.isNotNull(), answer("aggregate_rate_gbps", aggregate, "only_aggregate_rate")),
    )
    out = F
    for condition, result in rungs:
        out = out.when(condition, result)
    return out.otherwise(no("missing_fixed_bit_rate"))


def pairs(measurements: DataFrame, evidence: DataFrame, powers: Sequence[str], rates: Sequence[str], overlap: int = 40, refused: Sequence[str] = REFUSED) -> DataFrame:
    """Rows ``measurement, eligible, reason, shared, power_id, rate_id``: for each of ``measurements(measurement, source)`` the statements of its
    power and its rate that share the longest run of signs.

    ``evidence`` has measurement, id, field, source, locator, abstract, review, confidence, text. Both statements must be of the measurement's
    source and of one place: equal locators (null is empty) and, if either has one, equal abstracts. Of equal runs the power with the
    higher confidence counts, then smaller ids. Statements from abstracts need ``overlap`` shared signs.

    Equal texts of a place are one candidate (the first by confidence and id), so a place's pairs are those of its different texts, and
    runs are only measured where source and place agree. Nulls in review and confidence mean none and 0.
    """
    e = evidence.where(~F.coalesce(F.col("review").isin(list(refused)), F.lit(False))).join(measurements.select("measurement", "source"), ["measurement", "source"], "left_semi")
    e = e.withColumn("text", folded(F.col("text"))).withColumn("place", F.coalesce("locator", F.lit(""))).withColumn("sure", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
    place = ["measurement", "place", "abstract", "text"]
    p = e.where(F.col("field").isin(list(powers))).groupBy(*place).agg(F.max(F.struct("sure", (-F.col("id")).alias("neg"))).alias("p"))
    r = e.where(F.col("field").isin(list(rates))).groupBy(*place).agg(F.min("id").alias("rate_id"))
    r = r.select(F.col("measurement").alias("m"), F.col("place").alias("l"), F.col("abstract").alias("a"), F.col("text").alias("rate_text"), "rate_id")
    met = p.join(r, (F.col("measurement") == F.col("m")) & (F.col("place") == F.col("l")) & F.col("abstract").eqNullSafe(F.col("a")))
    rank = F.struct(longest_overlap(F.col("text"), F.col("rate_text")).alias("shared"), F.col("p.sure").alias("sure"), F.col("p.neg").alias("power"), (-F.col("rate_id")).alias("rate"))
    best = met.select("measurement", rank.alias("rank")).groupBy("measurement").agg(F.max("rank").alias("best"))
    has = e.groupBy("measurement").agg(F.max(F.col("field").isin(list(powers))).alias("has_power"), F.max(F.col("field").isin(list(rates))).alias("has_rate"))
    out = measurements.select("measurement", "source").join(has, "measurement", "left").join(best, "measurement", "left")
    b = F.col("best")
    short = (F.col("source") == "abstract") & (b["shared"] < overlap)
    reason = (
        F.when(~F.coalesce("has_power", F.lit(False)), "missing_power_evidence").when(~F.coalesce("has_rate", F.lit(False)), "missing_rate_evidence")
        .when(b.isNull(), "cross_source_or_locator").when(short, "abstract_context_not_shared").otherwise("same_source_locator"))
    return out.select("measurement", (reason == "same_source_locator").alias("eligible"), reason.alias("reason"), b["shared"].alias("shared"), (-b["power"]).alias("power_id"), (-b["rate"]).alias("rate_id"))
