"""Pairs of conference and journal papers on hand-made cases, and the choice among them."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import families

AUTHORS = "Y. Kim, A. Lee, B. Park"
PAPERS = [
    (1, "6.1 A 112Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7nm", AUTHORS, 2020, "ISSCC", 7.0),
    (2, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", AUTHORS, 2021, "JSSC", 7.0),
    (3, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizers in 7-nm", AUTHORS, 2022, "JSSC", 5.0),
    (4, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", AUTHORS, 2019, "JSSC", 7.0),
    (5, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", AUTHORS, 2024, "JSSC", 7.0),
    (6, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", "C. Chen, Y. Kim", 2021, "JSSC", 7.0),
    (7, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", AUTHORS, 2021, "CICC", 7.0),
    (8, "Fast Memory Interface", AUTHORS, 2021, "JSSC", None), (9, None, None, None, None, None), (10, "", "Y. Kim", 2021, "JSSC", None),
    (11, "A 112-Gb/s PAM-4 Transceiver With Adaptive Equalizer in 7-nm", "A. Lee, Y. Kim, B. Park", 2021, "JSSC", 7.0),
]


def test_pairs(spark):
    df = spark.createDataFrame(PAPERS, "id int, title string, authors string, year int, venue string, node double")
    found = families.scored_pairs(df, {"ISSCC": ["JSSC"]}, lambda a, b: {"process_nm": families.agree(a["node"], b["node"], 0.02)})
    got = {(r["conference"], r["journal"]): r for r in found.collect()}
    assert set(got) == {(1, 2), (1, 3)}
    best, clash = got[1, 2], got[1, 3]
    assert best["strict"] and best["exact_title"] and best["score"] == pytest.approx(1.0) and best["matches"] == ["process_nm"] and best["year_gap"] == 1
    assert not clash["strict"] and clash["conflicts"] == ["process_nm"] and 0.65 < clash["score"] < 0.82
    assert families.scored_pairs(df.limit(0), {"ISSCC": ["JSSC"]}).count() == 0


def test_family_titles(spark):
    df = spark.createDataFrame([("6.1 A 7nm Link", True), ("6.1 A 7nm Link", False), ("112-Gb/s Link", True), (None, True)], "t string, s boolean")
    assert [r[0] for r in df.select(families.family_title(F.col("t"), F.col("s"))).collect()] == ["7 nm link", "6 1 7 nm link", "112 gb s link", ""]


def test_one_family_a_conference_paper(spark):
    rows = [(1, 10, "auto_grouped", 0.9), (2, 10, "approved", 0.5), (3, 10, "rejected", 1.0), (4, 11, "auto_grouped", 0.7), (5, 11, "auto_grouped", 0.7), (6, 12, None, 1.0), (7, 13, "approved", None)]
    df = spark.createDataFrame(rows, "id int, conference int, status string, score double")
    assert {(r["id"], r["selected"]) for r in families.selected(df, "id", "conference", "status", "score").collect()} == {(1, False), (2, True), (4, True), (5, False), (7, True)}


def test_pairs_meet_once_and_are_not_shuffled(spark):
    import random

    rng = random.Random(5)
    title = lambda: " ".join(rng.sample("adaptive equalizer transceiver optical memory coherent burst retimer".split(), 4))
    people = lambda: ", ".join(f"X. {n}" for n in rng.sample("Kim Lee Park Choi Jung Cho".split(), rng.randint(1, 6)))
    papers = [(i, title(), people(), 2020 + i % 3, "ISSCC" if i % 2 else "JSSC") for i in range(160)]
    found = families.scored_pairs(spark.createDataFrame(papers, "id int, title string, authors string, year int, venue string"), {"ISSCC": ["JSSC"]})
    got = {(r["conference"], r["journal"]): (r["token_jaccard"], r["shared_authors"]) for r in found.collect()}
    assert len(got) == found.count() > 50
    names = lambda p: [n[3:] for n in p[2].split(", ")]
    near = {}
    for a in (p for p in papers if p[4] == "ISSCC"):
        for b in (p for p in papers if p[4] == "JSSC" and 0 <= p[3] - a[3] <= 3):
            both, every, x, y = set(names(a)) & set(names(b)), set(names(a)) | set(names(b)), set(a[1].split()), set(b[1].split())
            known = names(a)[0] == names(b)[0] or (len(both) >= 4 and len(both) / len(every) >= 0.6)
            if len(both) >= 2 and known and len(x & y) / len(x | y) >= 0.4:
                near[a[0], b[0]] = (len(x & y) / len(x | y), len(both))
    assert got.items() <= near.items()
    exact = {k for k, v in near.items() if papers[k[0]][1] == papers[k[1]][1]}
    assert exact <= set(got)
    assert any(papers[a][2].split(", ")[0] != papers[b][2].split(", ")[0] for a, b in got)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_scored_in_cells_alike(spark, monkeypatch):
    import random

    from foliant.operators import resolve

    rng = random.Random(9)
    parts = ("A", "A Low-Power", "Adaptive"), ("112-Gb/s", "60-GHz"), ("PAM-4 Receiver", "Optical Receiver", "Retimer", "VCSEL Driver"), ("for Links", "With a Temperature Sensor"), ("", "in 28-nm CMOS")
    people = ["Kim", "Lee", "Park", "Choi", "Jung"]
    papers = [(i, " ".join(rng.choice(p) for p in parts), ", ".join(f"X. {n}" for n in rng.sample(people, rng.randint(2, 5))), 2019 + i % 5, "ISSCC" if i % 2 else "JSSC", float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(papers, "id int, title string, authors string, year int, venue string, node double")
    score = lambda: sorted(map(tuple, families.scored_pairs(df, {"ISSCC": ["JSSC"]}, lambda a, b: {"node": families.agree(a["node"], b["node"], 0.1)}).collect()), key=repr)
    whole = score()
    monkeypatch.setattr(resolve, "CELL", 3)  # the same pairs, once each, of cells of some three papers
    assert score() == whole and len({r[:2] for r in whole}) == len(whole) > 20
    keys = {r["id"]: r["k"] for r in df.select("id", families.family_title(F.col("title"), F.col("venue") == "ISSCC").alias("k")).collect()}
    from difflib import SequenceMatcher
    for conference, journal, _, similarity, *_ in whole:
        a, b = keys[conference], keys[journal]
        words = len(set(a.split(" ")) & set(b.split(" "))) / len(set(a.split(" ")) | set(b.split(" ")))
        plain = 1.0 if a == b else 0.62 * SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.38 * words
        assert similarity == pytest.approx(plain, abs=1e-12) or (similarity < 0.65 and a == b)
