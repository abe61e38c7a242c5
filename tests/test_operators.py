"""Rules of single operators on hand-built rows, and independence of the input's order."""

import datetime as dt
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foliant.functions import semantics as S
from foliant.functions import terms
from foliant.operators import extract, families, figures, graph, ingest, measure, ranking, references, relate, resolve, select, state, text
from foliant.sources import tables
from foliant.streaming import sessions


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_year_number_takes_leading_digits(spark):
    df = spark.createDataFrame([("2024a",), (" 1999",), ("n.d.",), (None,)], "y string")
    assert [r[0] for r in df.select(S.year_number(F.col("y"))).collect()] == [2024, 1999, 0, 0]


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("a 50% receiver",), ("a 500 receiver",), (None,)], "t string")
    assert df.where(S.any_contains([F.col("t")], "50%")).count() == 1


def test_normal_doi_and_identity(spark):
    df = spark.createDataFrame([("https://doi.org/10.1109/ABC.1",), ("DOI: 10.1109/abc.1",), ("not one",), (None,)], "d string")
    assert [r[0] for r in df.select(S.normal_doi(F.col("d"))).collect()] == ["10.1109/abc.1", "10.1109/abc.1", None, None]


def test_best_applies_the_predicate_first(spark):
    rows = [(1, 9, None), (1, 5, 2.0), (1, 4, 3.0), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, rank int, x double")
    assert values(ranking.best(df, ["k"], [F.col("rank")], ["rank", "x"], F.col("x").isNotNull()), "k", "rank", "x") == [(1, 5, 2.0)]


def test_pareto_keeps_ties_and_needs_three(spark):
    rows = [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 1.5, 3.0), ("a", 3.0, float("nan")), ("b", 1.0, 1.0), ("b", 2.0, 1.0)]
    want = [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0)]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "g string, x double, y double")
        assert values(measure.pareto(df, ["g"], "x", "y"), "g", "x", "y") == want


def test_outliers_need_eight_rows_and_spread(spark):
    rows = [("a", float(x)) for x in (10, 11, 9, 10, 12, 10, 9, 1000)] + [("b", 1.0)] * 8 + [("c", float(x)) for x in (1, 2, 3, 4, 5, 6, 999)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert values(measure.robust_outliers(df, ["g"], F.col("v")), "g", "v") == [("a", 1000.0)]


def test_completeness_and_gate(spark):
    df = spark.createDataFrame([(1, 5.0, None, "t"), (1, None, 2.0, "m"), (2, None, None, "m")], "k int, a double, b double, s string")
    found = measure.completeness(df, "k", {"a": F.col("a").isNotNull(), "b": F.col("b").isNotNull()}, F.col("s") == "t")
    assert values(found, "k", "a", "b", "status") == [(1, 1, 2, "inferred"), (2, 0, 0, "metadata_only")]
    gate = spark.createDataFrame([("x", 7, 10.0), ("y", 6, 10.0), ("z", 0, None)], "k string, n int, usual double")
    assert values(measure.drop_gate(gate, "k", "n", "usual"), "k", "ok") == [("x", True), ("y", False), ("z", False)]


def greedy_interleave(groups, limit):
    """The sequential rule: take from the group with the least share taken, then the higher head, then the name."""
    queues = {g: sorted(v, reverse=True) for g, v in groups.items()}
    size, taken, out = {g: len(v) for g, v in groups.items()}, {g: 0 for g in groups}, []
    while len(out) < limit and any(queues.values()):
        g = min((g for g in queues if queues[g]), key=lambda g: (taken[g] / size[g], -queues[g][0], g))
        out.append((g, queues[g].pop(0)))
        taken[g] += 1
    return out


def test_weighted_interleave_equals_the_sequential_rule(spark):
    groups = {"a": [9, 8, 7, 6], "b": [5, 4], "c": [10]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v int")
    found = ranking.weighted_interleave(df, "g", [F.desc("v")], F.col("v"), 6)
    assert [(r["g"], r["v"]) for r in found.collect()] == greedy_interleave(groups, 6)


def test_largest_remainder_sums_up(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "g string, n int")
    assert values(ranking.largest_remainder(df, "g", "n", 10), "g", "quota") == [("a", 4), ("b", 4), ("c", 2)]


def test_sequence_and_batches_count_on(spark):
    df = spark.createDataFrame([(p, i) for p in ("P1", "P0") for i in range(3)], "p string, i int")
    found = ranking.batches(ranking.sequence(df, ["p"], [F.col("i")]), 4)
    assert values(found, "sequence", "p", "i", "batch", "item")[3:5] == [(4, "P1", 0, 1, 4), (5, "P1", 1, 2, 1)]


def test_override_precedence(spark):
    base = spark.createDataFrame([(1, "optical"), (2, None), (3, "optical")], "k int, m string")
    override = spark.createDataFrame([(1, "electrical", "approved"), (3, "electrical", "draft")], "k int, m string, status string")
    found = relate.with_override(base, override, "k", "m", F.col("status") == "approved", "unknown")
    assert values(found, "k", "m") == [(1, "electrical"), (2, "unknown"), (3, "optical")]


def test_mutual_best_needs_a_margin(spark):
    rows = [(1, 10, 0.9), (1, 11, 0.87), (2, 12, 0.8), (3, 12, 0.7)]
    df = spark.createDataFrame(rows, "l int, r int, score double")
    assert values(resolve.mutual_best(df, "l", "r", "score").where("mutual"), "l", "r") == [(2, 12)]


def test_pairs_of_classes_equal_all_pairs(spark):
    import random

    rng = random.Random(7)
    deal = lambda start, n: [(start + i, rng.choice([1, 1, 2, None]) if i % 3 else 1, t) for i in range(n) for t in rng.sample("abcde", rng.randint(1, 3))]
    left, right = sorted(set(deal(0, 40)), key=repr), sorted(set(deal(100, 25)), key=repr)
    a, b = spark.createDataFrame(left, "l int, block int, term string"), spark.createDataFrame(right, "r int, block int, term string")
    own = lambda rows, i: {r[1:] for r in rows if r[0] == i}
    wanted = []
    for i in sorted({r[0] for r in left}):
        for j in sorted({r[0] for r in right}):
            x, y = own(left, i), own(right, j)
            if both := {k for k in x & y if k[0] is not None}:
                wanted.append((i, j, len(both), round(len(both) / (len(x) + len(y) - len(both)), 9)))
    pairs, left_members, right_members = resolve.class_pairs(a, b, "l", "r")
    assert pairs.count() < len(wanted)
    expanded = resolve.members_of(pairs, left_members, right_members, "l", "r")
    assert values(expanded, "l", "r", "shared", "score") == sorted(wanted, key=repr)
    for margin in (0.04, 0.2):
        plain = resolve.mutual_best(spark.createDataFrame(wanted, "l int, r int, shared long, score double"), "l", "r", "score", margin).where("mutual")
        assert values(resolve.mutual_classes(pairs, "l", "r", margin), "l", "r", "shared", "score") == values(plain, "l", "r", "shared", "score")


def test_mutual_pairs_meet_in_cells_and_equal_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(resolve, "CELL", 4)  # several cells a block; slices and products of matrices are cut in the workers by their own sizes
    rng = random.Random(11)
    deal = lambda start, n: [(start + i, rng.choice([1, 1, 2, None]) if i % 3 else 1, t) for i in range(n) for t in rng.sample("abcdefg", rng.randint(1, 5))]
    left, right = sorted(set(deal(0, 60)), key=repr), sorted(set(deal(100, 50)), key=repr)
    a, b = spark.createDataFrame(left, "l int, block int, term string"), spark.createDataFrame(right, "r int, block int, term string")
    own = lambda rows, i: {r[1:] for r in rows if r[0] == i}
    wanted = []
    for i in sorted({r[0] for r in left}):
        for j in sorted({r[0] for r in right}):
            x, y = own(left, i), own(right, j)
            if both := {k for k in x & y if k[0] is not None}:
                wanted.append((i, j, len(both), round(len(both) / (len(x) + len(y) - len(both)), 9)))
    assert len({r[0] for r in left}) > 3 * resolve.CELL
    for margin in (0.01, 0.04, 0.2):
        plain = resolve.mutual_best(spark.createDataFrame(wanted, "l int, r int, shared long, score double"), "l", "r", "score", margin).where("mutual")
        assert values(resolve.mutual_pairs(a, b, "l", "r", margin), "l", "r", "shared", "score") == values(plain, "l", "r", "shared", "score")
    assert resolve.mutual_pairs(a.limit(0), b, "l", "r").count() == 0

def test_class_pairs_below_the_floor_never_leave_their_cell(spark):
    deal = lambda start: [(start + i, i % 3, t) for i in range(12) for t in "abcdef"[i % 4 : i % 4 + 1 + i % 3]]
    a, b = spark.createDataFrame(deal(0), "l int, block int, term string"), spark.createDataFrame(deal(100), "r int, block int, term string")
    every, left, right = resolve.class_pairs(a, b, "l", "r")
    some, _, _ = resolve.class_pairs(a, b, "l", "r", floor=0.4)
    wanted = [tuple(r) for r in every.collect() if r["score"] >= 0.4]
    assert 0 < len(wanted) < every.count() and sorted(map(tuple, some.collect())) == sorted(wanted)
    columns = ["l", "r", "shared", "score"]
    assert values(resolve.members_of(some, left, right, "l", "r"), *columns) == values(resolve.members_of(every.where("score >= 0.4"), left, right, "l", "r"), *columns)



def test_sticky_decisions_stay(spark):
    fresh = spark.createDataFrame([(1, 1, "auto"), (2, 2, "auto")], "l int, r int, decision string")
    old = spark.createDataFrame([(1, 1, "rejected"), (2, 2, "open")], "l int, r int, decision string")
    assert values(resolve.sticky(fresh, old, ["l", "r"]), "l", "decision") == [(1, "rejected"), (2, "auto")]


def test_sequence_ratios_of_batches_equal_difflib():
    import random
    from difflib import SequenceMatcher

    import numpy as np

    from foliant.operators.text import ratios

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(40)] + ["".join(rng.choice("abcdefgh \uac00\u00e9") for _ in range(rng.randint(0, 60))) for _ in range(20)]
    texts += ["", "x" * 249, "x" * 250, "x" * 300, "ab" * 140, "\U0001f600ab"] + ["".join(chr(rng.randint(40, 900)) for _ in range(80)) for _ in range(3)]
    a, b = [x for x in texts for _ in texts], [y for _ in texts for y in texts]
    wanted = np.array([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])
    assert (ratios(a, b, np.zeros(len(a))) == wanted).all() and len(ratios([], [], np.zeros(0))) == 0
    found = ratios(a, b, np.full(len(a), 0.6))
    assert ((found == wanted) | ((found == 0) & (wanted < 0.6))).all() and (found == 0).any()


def test_near_titles_equal_brute_force(spark):
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(4)
    base = ["A 56 Gb/s receiver in CMOS with adaptive equalizer", "The low power receiver with adaptive equalizer for links", "A wideband modulator, Part I: theory and limits of operation"]
    rows = base + [base[0] + ".", base[0].replace("56", "112"), base[0].replace("receiver", "receivers"), base[1].replace("The", "A"), base[2].replace("Part I:", "Part II:"), base[1].upper(), "", None, "abcd", "abce"]
    for t in base * 12:
        at = rng.randint(0, len(t) - 4)
        rows.append(t[:at] + rng.choice(["", "x", "yz"]) + t[at + rng.randint(0, 4):])
    rows = list(enumerate(rows))
    name = lambda t: re.sub(r"[^a-z0-9.]", "", re.sub(r"^\s*\d+\.\d+\s+", "", (t or "").lower()))
    numbers, part = lambda t: re.findall(r"\d+(?:\.\d+)?", name(t)), lambda t: re.findall(r"\bpart\s+([ivx]+|\d+)\b", (t or "").lower())
    first = {}
    for i, t in rows:
        if name(t):
            first.setdefault(name(t), (i, t))
    want = {(first[name(t)][0], i) for i, t in rows if name(t) and first[name(t)][0] != i}
    reps = list(first.values())
    want |= {(i, j) for i, s in reps for j, t in reps if i < j and numbers(s) == numbers(t) and part(s) == part(t) and SequenceMatcher(None, name(s), name(t), autojunk=False).ratio() >= 0.94}
    found = text.same_titles(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want) > 30


def test_unknown_filters_are_refused():
    from foliant.operators import records

    with pytest.raises(ValueError, match="secret"):
        records.checked_filters({"secret": 1}, ["name"])


def test_coupling_and_cocitation(spark):
    refs = spark.createDataFrame([(1, 100), (1, 101), (2, 100), (2, 101), (3, 1), (3, 2)], "citing long, cited long")
    found = graph.weights(refs, spark.createDataFrame([(1,)], "seed long"))
    row = {r["node"]: r for r in found.collect()}
    assert row[2]["shared"] == 2 and row[2]["co"] == 1 and row[2]["weight"] == pytest.approx(0.65 + 0.35 / 3, abs=1e-9)
    assert row[100]["direct"] == 1 and row[100]["weight"] == pytest.approx(0.12)


def test_lineage_survives_a_cycle(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "citing long, cited long")
    assert values(graph.lineage(refs, spark.createDataFrame([(1,)], "node long"), 3), "node", "level") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_unambiguous_and_merit(spark):
    df = spark.createDataFrame([("56 Gb/s and 56 Gb/s",), ("56 Gb/s or 112 Gb/s",), ("none",)], "t string")
    assert [r[0] for r in df.select(extract.unambiguous(extract.numbers(F.col("t"), "Gb/s"))).collect()] == [56.0, None, None]
    row = spark.createDataFrame([(224.0, 112.0)], "p double, r double").select(extract.merit(F.col("p"), F.col("r"))).first()
    assert row[0] == 2.0


def test_upsert_never_blanks(spark):
    old = spark.createDataFrame([(1, "Kim", "10.1/a", 1), (2, "Lee", None, 0)], "k int, authors string, doi string, pdf int")
    new = spark.createDataFrame([(1, "N/A", "10.1/b", 0), (3, "Cho", "10.1/c", 1)], "k int, authors string, doi string, pdf int")
    found = ingest.upsert(old, new, "k", replace=["authors"], keep=["doi"], most=["pdf"])
    assert values(found, "k", "authors", "doi", "pdf") == [(1, "Kim", "10.1/a", 1), (2, "Lee", None, 0), (3, "Cho", "10.1/c", 1)]


def test_change_plan_gives_one_reason(spark):
    current = spark.createDataFrame([(1, None), (2, "d2"), (3, "d3")], "k int, doi string")
    plan = spark.createDataFrame([(1, None, "n1"), (2, "d2", "d2"), (3, "old", "n3"), (9, None, "n9"), (2, "d2", None), (1, None, "d3")], "k int, expected string, proposed string")
    assert values(ingest.plan_changes(plan, current, "k", "doi"), "k", "proposed", "verdict") == sorted(
        [(1, "n1", "accept"), (2, "d2", "already_applied"), (3, "n3", "stale"), (9, "n9", "missing_row"), (2, None, "preserved"), (1, "d3", "collision")], key=repr)


def test_status_by_age_and_versions(spark):
    now = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, now - dt.timedelta(seconds=300)), (2, now - dt.timedelta(hours=2)), (3, now - dt.timedelta(days=3))], "u int, ts timestamp")
    assert values(state.rollup(df, "u", "ts", F.lit(now)), "u", "status") == [(1, "online"), (2, "idle"), (3, "offline")]
    current = spark.createDataFrame([(1, 4)], "k int, version int")
    updates = spark.createDataFrame([(1, 4), (1, 3), (2, 1)], "k int, version int")
    assert values(state.versioned_update(current, updates, "k"), "k", "version", "outcome") == [(1, 3, "conflict"), (1, 4, "applied"), (2, 1, "missing")]


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 24, 5), i % 3, "ab"[i % 2], 1.0, "{}") for i in range(48)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = sessions.counts(sessions.read_events(spark, str(tmp_path / "in")), width="6 hours")
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 48 and spark.table("windows").count() == 8


def test_csv_batches_take_the_latest_file(spark, tmp_path):
    import os

    for name, title, at in (("a.csv", "old", 1_700_000_000), ("b.csv", "new", 1_700_000_100)):
        (tmp_path / name).write_text(f"Key,Title\n1,{title}\n")
        os.utime(tmp_path / name, (at, at))
    found = tables.csv_batches(spark, str(tmp_path), ["key"], {"key": ["Key", "Article"], "title": ["Title"], "doi": ["DOI"]})
    assert values(found, "key", "title", "doi") == [("1", "new", None)]


def test_exports_are_safe(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 3)], "t string, n int")
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["t"] == "'=1+1"
    record = df.select(tables.ris(F.lit("T"), F.lit("Kim; Lee"), F.lit(2024), F.lit(""), F.lit("10.1/x"))).first()[0]
    assert record == "TY  - JOUR\nTI  - T\nAU  - Kim\nAU  - Lee\nPY  - 2024\nDO  - 10.1/x\nER  - "


def test_diverse_selection_spreads(spark):
    rows = [(1, 90.0, "a", "v", ["x", "y"]), (2, 89.0, "a", "v", ["x", "y"]), (3, 70.0, "b", "w", ["z"]), (4, 69.0, "a", "w", ["q"])]
    for own in (rows, rows[::-1]):
        found = select.diverse(spark.createDataFrame(own, "id long, score double, topic string, venue string, terms array<string>"), 3)
        # 2 loses 12 + 4 + 25 to 1 and is at 48 then; 4 loses 12, and 4 more to 3
        assert [(r["id"], r["value"]) for r in found.orderBy("place").collect()] == [(1, 90.0), (3, 70.0), (4, 53.0)]


def test_batches_hold_few_rows_and_little_text(spark):
    rows = [("g", i, s) for i, s in enumerate([10, 10, 10, 90, 200, 5, 5, 5, 5, 5, 5])] + [("h", 99, 1)]
    found = select.bounded_batches(spark.createDataFrame(rows, "g string, i long, s int"), "g", ["i"], "i", "s", most=5, room=100)
    assert [r["batch"] for r in found.orderBy("g", "i").collect()] == [1, 1, 1, 2, 3, 4, 4, 4, 4, 4, 5, 1]


def test_reference_lists_need_whole_labels(spark):
    pages = [(1, "Body [3].\nReferences\n[1] A. Kim, \"A title,\" 2021, doi 10.1109/X.1.\n[2] B\n  two\nAppendix\n[3] no"), (2, "References\n[1] A\n[3] C"), (3, "no list [1] here"), (4, None)]
    found = references.segments(spark.createDataFrame(pages, "id int, t string"), "id", "t")
    assert values(found, "id", "number", "entry") == [(1, 1, 'A. Kim, "A title," 2021, doi 10.1109/X.1.'), (1, 2, "B two")]
    one = found.where("number = 1").select(*[c.alias(n) for n, c in references.fields(F.col("entry")).items()]).first()
    assert (one["title"], one["year"], one["authors"]) == ("A title", 2021, "A. Kim")


def test_rebuilt_index_rejects_gaps(spark):
    df = spark.createDataFrame([({"a": [0, 2], "b": [1]},), ({"a": [0], "b": [2]},), ({"a": [0], "b": [0]},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(references.rebuilt(F.col("m"))).collect()] == ["a b a", None, None]


def test_error_rates(spark):
    df = spark.createDataFrame([("BER < 1e-12",), ("3×10^-6",), ("10-9",), ("none",)], "t string")
    assert [r[0] if r[0] is None else float(f"{r[0]:.3g}") for r in df.select(extract.error_rate(F.col("t"))).collect()] == [1e-12, 3e-6, 1e-9, None]


FIGURES = [
    ("A 4 x 28 Gb/s transceiver in 65-nm CMOS at 1.5 pJ/bit", {"rate_gbps": 28.0, "rate_scope": "lane", "lane_count": 4, "lane_rate_gbps": 28.0, "aggregate_rate_gbps": 112.0, "energy_pj_bit": 1.5, "process_nm": 65.0}),
    ("From 25 to 10 Gb/s, total power 35 mW", {"rate_min_gbps": 10.0, "rate_max_gbps": 25.0, "rate_scope": "unknown", "power_mw": 35.0}),
    ("An aggregate 1.12-Tb/s link, 2 mW/Gb/s and 30 dB channel loss", {"rate_gbps": 1120.0, "rate_scope": "aggregate", "aggregate_rate_gbps": 1120.0, "energy_pj_bit": 2.0, "channel_loss_db": 30.0}),
    ("56 Gb/s/lane, 28 GBaud, BER below 1e-12", {"rate_gbps": 56.0, "rate_scope": "lane", "lane_rate_gbps": 56.0, "symbol_rate_gbaud": 28.0, "ber": 1e-12, "ber_scope": "unknown"}),
    ("25 Gb/s and 32 Gb/s with 500 fJ/bit/dB and 20 uW, then 3 W", {"energy_pj_bit_db": 0.5, "ambiguous": ["rate_gbps", "power_mw"]}),
    ("1.2 Tb/s/mm with a 1550 nm laser in 0.13 um SiGe and 30 dB of gain", {"density_gbps_mm": 1200.0, "process_nm": 130.0}),
    ("10 GB/s is no bit rate, 3 mW is 3 mW", {"power_mw": 3.0}),
    ("A receiver in 28 nm", {"process_nm": 28.0}),
    ("An optical receiver in 28 nm", {}),
    ("A CMOS-compatible 300 nm waveguide filter", {}),
    ("A 4 0nm CMOS driver", {"ambiguous": ["process_nm"]}),
    ("A 20 W/(Gb/s) link", {"ambiguous": ["energy_pj_bit"]}),
    ("A 20 W/(Gb/s)/dB link", {"ambiguous": ["energy_pj_bit_db"]}),
    ("A PAM4mW link", {}),
    ("5&nbsp;mW and 5\u00a0mW", {"power_mw": 5.0}),
    ("36 $\\mu$W at 2.5 GBd", {"power_mw": 0.036, "symbol_rate_gbaud": 2.5}),
    ("Insertion loss of 20 dB at 14 GHz, a pre-FEC bit-error rate of 3 × 10^-6", {"channel_loss_db": 20.0, "loss_frequency_ghz": 14.0, "ber": 3e-6, "ber_scope": "pre_fec"}),
    ("1.5 pJ/b and 1500 fJ/bit at 32 Gb/s/pin", {"energy_pj_bit": 1.5}),
    ("10-12 and 20-28 Gb/s, 5 to 6 Gb/s", {"ambiguous": ["rate_gbps"]}),
    ("", {}),
]


def test_performance_gives_only_what_is_unambiguous(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(FIGURES)], "i int, x string")
    for r in df.select("i", figures.performance(F.col("x")).alias("p")).collect():
        got = {k: v for k, v in r["p"].asDict().items() if v not in (None, [])}
        assert got == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in FIGURES[r["i"]][1].items()}, FIGURES[r["i"]]
    none = spark.createDataFrame([(None,)], "x string").select(figures.performance(F.col("x")).alias("p")).first()["p"]
    assert not any(v for v in none.asDict().values())


def test_figures_carry_their_clause(spark):
    df = spark.createDataFrame([("It works. The chip takes 3 mW; it is small. " + "x" * 200_000 + " 4 x 5 Gb/s",)], "x string")
    found = df.select(figures.occurrences(F.col("x")).alias("f")).first()["f"]
    assert [(f["kind"], f["raw"], f["value"]) for f in found] == [("bit_rate", "4 x 5 Gb/s", 5.0), ("power", "3 mW", 3.0)]
    assert found[1]["excerpt"] == "The chip takes 3 mW; it is small." and len(found[0]["excerpt"]) <= 170


def test_guards_and_families(spark):
    rows = ["less than 5 mW", "2 mW/Gb/s", "standby 3 uW", "4 mW/channel", "OMA of 1 mW", "heater power 2 mW", "consumes 3 mW", None, "10 to 28 Gb/s", "up to 56 Gb/s", "bi-CMOS and CMOS", "FinFET chiplet"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    x = F.col("x")
    got = [tuple(r) for r in df.select(figures.power_guard(x), figures.rate_guard(x), figures.technology_family(x), figures.link_class(x)).collect()]
    assert [r[0] for r in got[:8]] == ["bounded_power", "already_normalized_power_per_rate", "inactive_state_power", "per_channel_power_scope", "non_consumption_power", "subblock_power", None, None]
    assert [r[1] for r in got[8:10]] == ["rate_range_without_operating_point", "bounded_rate"]
    assert [r[2:] for r in got[10:]] == [("BiCMOS", None), ("CMOS", "die_to_die")] and got[7][2] == "Other / unspecified"
    loose = spark.createDataFrame([("sleep  mode 3 mW",), ("5 mW\nper channel",)], "x string")
    assert [r[0] for r in loose.select(figures.power_guard(x)).collect()] == ["inactive_state_power", "per_channel_power_scope"]
    assert spark.range(1).select(figures.link_class(F.lit("silicon\nphotonic"))).first()[0] == "optical"
    scopes = spark.createDataFrame([("12 mW per lane", None), ("the receiver consumes 5 mW", None), ("12 mW per lane", "full link"), ("5 mW", "x"), (None, None)], "x string, s string")
    assert [r[0] for r in scopes.select(figures.power_scope(x, F.col("s"))).collect()] == ["lane", "aggregate", "aggregate", "unknown", "unknown"]


def test_terms_keep_modulation_orders_apart(spark):
    df = spark.createDataFrame([("A PAM-4 Phase\u2013Locked Loop Receiver for 7nm low-power CMOS",), (None,), ("",)], "x string")
    x = F.col("x")
    got = [[sorted(v) if v else v for v in r] for r in df.select(terms.title_terms(x), terms.technical_terms(x), terms.graph_terms(x)).collect()]
    assert got[0] == [["cmos", "loop", "low-power", "pam", "phase-locked", "receiver"], ["low-power", "pam4", "pll", "receiver"], ["cmos", "locked", "loop", "pam", "phase", "power", "receiver"]]
    assert got[1] == [None, None, None] and got[2] == [[], [], []]


def test_graph_term_counts_leave_out_title_stop_words_alone(spark, tmp_path):
    from foliant.plans import registry

    spark.createDataFrame([("the first measured figure of 5 gbps",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["graph_term_counts"](spark, str(tmp_path))
    assert values(found, "term", "n") == [("figure", 1), ("first", 1), ("gbps", 1), ("measured", 1)]


def test_graph_and_technical_terms(spark):
    df = spark.createDataFrame([("Two measurement techniques shown in a figure: 5 gbps equalizer\uac00\ub098",), (None,)], "x string")
    assert [r[0] for r in df.select(terms.graph_terms(F.col("x"))).collect()] == [["equalizer"], None]
    wide = spark.createDataFrame([("\uff30\uff21\uff2d\uff14 &amp; Receiver",)], "x string")
    assert sorted(wide.select(terms.technical_terms(F.col("x"))).first()[0]) == ["pam4", "receiver"]


def test_names_of_authors(spark):
    df = spark.createDataFrame([("Kim, A. B. Lee, and C. Park",), ("Park, A.;\nSmith",), ("",), (None,)], "a string")
    got = [r[0] for r in df.select(terms.surnames(F.col("a"))).collect()]
    assert got == [["kim", "lee", "park"], ["a", "smith"], [], None]


def test_fingerprints_of_pairs(spark):
    cols = "pa double, pb double, la double, ha double, lb double, hb double, ba array<string>, bb array<string>"
    rows = [(65.0, 65.4, 10.0, 25.0, 25.4, 25.4, ["TX"], ["RX"]), (65.0, 28.0, 10.0, 10.0, 10.4, 10.4, ["TX", "RX"], ["RX"]), (None, 28.0, 10.0, 10.0, 20.0, 20.0, ["PLL"], ["TX"])]
    c = F.col
    p = families.fingerprint({"process": families.agree(c("pa"), c("pb"), 0.02, 0.5), "rate": families.spans_agree(c("la"), c("ha"), c("lb"), c("hb")), "block": families.blocks_agree(c("ba"), c("bb"))})
    got = [(r["p"]["matches"], r["p"]["conflicts"]) for r in spark.createDataFrame(rows, cols).select(p.alias("p")).collect()]
    assert got == [(["process", "rate"], ["block"]), (["block", "rate"], ["process"]), ([], ["rate"])]


def test_violations_of_families(spark):
    f = spark.createDataFrame([(1, True, 10), (2, False, 20)], "family_id long, active boolean, canonical long")
    m = spark.createDataFrame([(1, 10, True), (1, 11, False), (9, 12, False)], "family_id long, paper_id long, is_canonical boolean")
    k = spark.createDataFrame([(100, 1, "ok", 11, 10), (101, 1, "no", 11, 10), (102, 2, "ok", 21, 20), (103, 8, "ok", 1, 2), (104, None, "no", 1, 2), (105, 1, "ok", 10, 11)], "candidate_id long, family_id long, status string, conference_id long, journal_id long")
    assert values(families.violations(f, m, k, ["ok"]), "rule", "id") == sorted([
        ("candidate_of_inactive_family", 102), ("candidate_without_family", 103), ("inconsistent_journal_member", 102), ("inconsistent_journal_member", 105),
        ("ineligible_candidate_in_family", 101), ("member_without_family", 12)], key=repr)
    assert families.violations(f.where("family_id = 1"), m.where("family_id = 1"), k.where("candidate_id = 100"), ["ok"]).count() == 0


def test_violations_join_candidates_once_and_sort_no_families(spark):
    f = spark.createDataFrame([(1, True, 10), (1, True, 10), (None, True, 3), (2, False, 20)], "family_id int, active boolean, canonical int")
    m = spark.createDataFrame([(1, 10, True), (2, 20, True), (None, 3, True)], "family_id int, paper_id int, is_canonical boolean")
    k = spark.createDataFrame([(100, 1, "ok", 1, 10), (101, 2, "ok", 1, 20), (102, 1, "ok", 1, None)], "candidate_id int, family_id int, status string, conference_id int, journal_id int")
    found = families.violations(f, m, k, ["ok"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 2, plan
    assert sorted((r["rule"], r["id"] or 0) for r in found.collect()) == sorted([("active_family_without_one_canonical", 0), ("active_family_without_one_canonical", 1), ("active_family_without_one_canonical", 1), ("candidate_of_inactive_family", 101),
        ("inconsistent_journal_member", 102), ("inconsistent_journal_member", 102), ("member_without_family", 3)])


def test_tables_give_their_own_column_only(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    tables_ = [
        (row("", "[1]", "This<br>work") + row("Power (mW)", "9", "5") + row("Rate", "1", "2-3"), "ok", ["Power (mW): 5 mW", "Rate: 2-3"]),
        (row("", "BER", "Loss dB") + row("Proposed", "1e-12", "30") + row("[3]", "1", "2"), "ok", ["BER: 1e-12", "Loss dB: 30 dB"]),
        (row("", "this work", "this work") + row("a", "b", "c"), "no_unique_label", None), (row("a", "b") + row("c"), "ragged", None),
        ("<tr><td rowspan=2>this work</td></tr>", "spans", None), ("", "no_cells", None), (None, "no_cells", None), (row("", "prior to this work"), "no_unique_label", None)]
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(tables_)], "i int, h string")
    for r in df.select("i", families.own_figures(F.col("h")).alias("f")).collect():
        assert (r["f"]["status"], r["f"]["figures"]) == tables_[r["i"]][1:], r


def test_similar_titles_of_copies_equal_all_pairs(spark):
    import math
    import random

    from foliant.operators import text

    rng = random.Random(3)
    docs = [(i, rng.sample("abcdefg", rng.randint(1, 4))) for i in range(30)]
    docs = [(i, docs[i % 30][1], i % 7 == 0) for i in range(120)] + [(120, [], True), (121, None, True)]
    df = {t: sum(t in (ts or []) for _, ts, _ in docs) for t in "abcdefg"}
    weight = {t: (1 + math.log((len(docs) + 1) / (n + 1))) * (0.3 if t == "a" else 1) for t, n in df.items()}
    norm = lambda ts: math.sqrt(sum(weight[t] ** 2 for t in ts))
    wanted = []
    for i, x, seed in docs:
        near = []
        for j, y, _ in docs:
            both = set(x or []) & set(y or [])
            if seed and i != j and len(both) >= 2 and both != {"a"}:
                score = round(min(1.0, sum(weight[t] ** 2 for t in both) / (norm(x) * norm(y))), 6)
                near += [(-score, j, len(both))] if score >= 0.25 else []
        wanted += [(i, j, hits, -score, place) for place, (score, j, hits) in enumerate(sorted(near)[:9], 1)]
    found = text.similar(spark.createDataFrame(docs, "id int, ts array<string>, seed boolean"), "id", "ts", F.col("seed"), len(docs), ["a"], most=9)
    assert values(found, "seed", "id", "hits", "score", "place") == sorted(wanted, key=repr)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "_class" in plan  # pairs are of classes, not of copies


def test_best_per_field_shuffles_a_row_a_part_before_it_is_unpivoted(spark):
    from foliant.plans import registry

    plan = registry.QUERIES["best_per_field"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_a_table_is_parsed_once_for_all_its_figures(spark):
    df = spark.createDataFrame([("<tr><td>a</td></tr>",)], "h string").select(families.own_figures(F.col("h")).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("<tr[^>]*>") == 1
