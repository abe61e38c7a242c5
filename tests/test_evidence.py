"""Longest overlaps, rate choices and evidence pairs against plain versions."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.operators import evidence


def plain_longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = row[j] + 1 if x == y else 0
        best, row = max(best, *new), new
    return best


def test_longest_common_equals_the_table(spark):
    rng = random.Random(2)
    for k in range(300):
        a, b = ("".join(rng.choices("abc é😀"[: rng.randint(1, 7)], k=rng.randint(0, 60))) for _ in "ab")
        cut = rng.randint(0, len(a))
        b = b + a[cut : cut + rng.randint(0, 30)] + b
        assert evidence.longest_common(a, b) == plain_longest(a, b)
    long = "".join(rng.choices("abcdefgh ", k=100_000))
    other = "".join(rng.choices("ijklmnop ", k=100_000))
    assert evidence.longest_common(long + "x", other + long[30_000:70_000] + other) == 40_000 + (other[-1] == long[29_999]) + (other[0] == long[70_000])
    assert evidence.longest_common("a" * 50_000, "a" * 40_000) == 40_000
    df = spark.createDataFrame([("abc", "xbcx"), (None, "a"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(evidence.longest_overlap(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


NAMES = "reported lane aggregate least greatest lanes scope source".split()


@pytest.mark.parametrize("values, power, wanted", [
    ((None, 5.0, None, 1.0, None, None, None, "user_sheet"), "lane", (True, "lane_rate_gbps", 5.0, "spreadsheet_speed_column")),
    ((None, None, None, None, None, None, None, " User_Sheet"), None, (False, None, None, "missing_fixed_bit_rate")),
    ((5.0, None, None, None, 9.0, None, None, "pdf"), None, (False, None, None, "rate_range_without_operating_point")),
    ((5.0, None, None, None, None, None, "Aggregate ", "pdf"), None, (True, "reported_rate_gbps", 5.0, "explicit_aggregate_rate")),
    ((None, 3.0, None, None, None, None, "aggregate", "pdf"), None, (False, None, None, "missing_aggregate_rate")),
    ((5.0, None, 20.0, None, None, 4, "lane", "pdf"), "lane", (True, "reported_rate_gbps", 5.0, "per_lane_power")),
    ((5.0, 0.0, 20.0, None, None, 4, None, "pdf"), "lane", (True, "lane_rate_gbps", 5.0, "per_lane_power")),
    ((5.0, None, None, None, None, 4, None, "pdf"), "aggregate", (False, None, None, "missing_aggregate_rate")),
    ((5.0, None, 20.0, None, None, 4, None, "pdf"), "unknown", (False, None, None, "multilane_power_scope_unknown")),
    ((None, None, 20.0, None, None, 1, "lane", "pdf"), None, (False, None, None, "missing_lane_rate")),
    ((5.0, None, 20.0, None, None, None, None, None), "aggregate", (True, "aggregate_rate_gbps", 20.0, "explicit_total_power")),
    ((5.0, 4.0, 20.0, None, None, None, None, None), None, (True, "reported_rate_gbps", 5.0, "single_reported_rate")),
    ((None, None, 20.0, None, None, None, None, None), None, (True, "aggregate_rate_gbps", 20.0, "only_aggregate_rate")),
    ((None,) * 8, None, (False, None, None, "missing_fixed_bit_rate")),
])
def test_rate_choice(spark, values, power, wanted):
    kinds = "reported double, lane double, aggregate double, least double, greatest double, lanes int, scope string, source string, power string"
    df = spark.createDataFrame([(*values, power)], kinds)
    found = df.select(evidence.rate_choice({n: F.col(n) for n in NAMES}, F.col("power")).alias("c")).first()["c"]
    assert tuple(found) == wanted


def test_pairs_equal_a_plain_version(spark):
    rng, rows = random.Random(9), []
    for i in range(600):
        text = rng.choice(["It takes 5 mW at 10 Gb/s in a large  and quiet room", "it takes 5 MW at 10 gb/s", "nothing", None, "", "x" * 3000 + str(i % 7)])
        rows.append((rng.randint(0, 40), i, rng.choice(["power_mw", "reported_rate_gbps", "lane_rate_gbps", "ber"]), rng.choice(["abstract", "pdf"]), rng.choice([None, "", "p1"]), rng.choice([None, 1]), rng.choice([None, None, "rejected", "ok"]), rng.choice([None, 0.5, 1.0]), text))
    ms = [(m, rng.choice(["abstract", "pdf"])) for m in range(45)]
    ev = spark.createDataFrame(rows, "measurement long, id long, field string, source string, locator string, abstract long, review string, confidence double, text string").repartition(4)
    rates = evidence.RATE_FIELDS["reported_rate_gbps"]
    found = {r["measurement"]: tuple(r) for r in evidence.pairs(spark.createDataFrame(ms, "measurement long, source string"), ev, ["power_mw"], rates).collect()}
    fold = lambda t: " ".join((t or "").split()).lower()
    for m, source in ms:
        mine = [r for r in rows if r[0] == m and r[3] == source and r[6] != "rejected"]
        power, rate = [r for r in mine if r[2] == "power_mw"], [r for r in mine if r[2] in rates]
        met = [(SequenceMatcher(None, fold(p[8]), fold(q[8]), autojunk=False).find_longest_match().size, p[7] or 0.0, -p[1], -q[1]) for p in power for q in rate if (p[4] or "") == (q[4] or "") and p[5] == q[5]]
        best = max(met) if met else None
        reason = "missing_power_evidence" if not power else "missing_rate_evidence" if not rate else "cross_source_or_locator" if not met else "abstract_context_not_shared" if source == "abstract" and best[0] < 40 else "same_source_locator"
        assert found[m] == (m, reason == "same_source_locator", reason, *((best[0], -best[2], -best[3]) if best else (None, None, None)))
