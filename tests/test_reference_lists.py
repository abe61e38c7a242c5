"""Reference entries: defects, alignment against a plain loop, grounding and votes on hand-made cases."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliant.operators import reference_lists as L


@pytest.mark.parametrize("raw, wanted", [
    ("A. Author, “Title,” 2018.", []), ("[1] A. B, x. [2] C. D, y.", ["collapsed_reference_labels"]), ("(12 ] A. Author", ["collapsed_reference_labels"]), ("bad \ufffd sign", ["damaged_reference_text"]),
    ("tab\tand\nline are text", []), ("PRBS of 231-1 length", ["uncertain_scientific_notation"]), ("A 231-1 house", []), ("in 0.18 m CMOS", ["uncertain_scientific_notation"]), ("10 /10m wide", ["uncertain_scientific_notation"]),
    ("He received the degree", ["non_bibliographic_tail"]), ("x" * 5000, ["source_at_truncation_bound"]), (None, []), ("/mu m", ["uncertain_scientific_notation"]),
])
def test_defects(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "raw string").select(L.defects(F.col("raw"))).first()[0] == wanted


def test_alignment_equals_a_plain_loop(spark):
    rng = random.Random(3)
    words = "Kim Lee transceiver receiver link 28nm CMOS IEEE J. Solid-State Circuits vol pp 2018 \ufffd Fig. 3".split()

    def text(n):
        return " ".join(rng.choices(words, k=n))

    entries, source = [], []
    for p in range(12):
        for i in range(1, 9):
            raw = text(rng.choice([4, 12, 40]))
            entries.append((p, i, raw, rng.random() < 0.2, rng.random() < 0.3))
            other = raw if rng.random() < 0.3 else raw[: len(raw) // 2] + text(2) if rng.random() < 0.5 else raw.replace("Kim", "K1m").upper() + (" tail" * rng.choice([0, 30]))
            source.append((p, i + rng.choice([0, 0, 0, 1]), other, rng.random() < 0.3))
    e = spark.createDataFrame([*entries, (99, None, None, None, None)], "paper int, number int, raw string, ocr_review boolean, native boolean")
    source = list({(p, n): (p, n, r, o) for p, n, r, o in source}.values())
    s = spark.createDataFrame([*source, (99, None, "x", None)], "paper int, number int, raw string, ocr_review boolean")
    bad = {r["raw"]: bool(r["d"]) for r in e.select("raw", L.defects(F.col("raw")).alias("d")).union(s.select("raw", L.defects(F.col("raw")).alias("d"))).collect()}
    by, want = {(p, n): (r, o) for p, n, r, o in source}, set()
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()
    for p, n, raw, review, native in entries:
        if (p, n) in by:
            other, ocr = by[(p, n)]
            if bad[other] and not bad[raw] or (ocr and not review and (native or not bad[raw])):
                continue
            if ratio(raw, other) >= 0.82 or (min(len(raw), len(other)) >= 100 and ratio(raw[:180], other[:180]) >= 0.94):
                want.add((p, n, other))
    found = {tuple(r) for r in L.aligned(e, s).collect()}
    assert found == want and len(want) > 10


def test_choice_of_lists(spark):
    lists = lambda rows: spark.createDataFrame(rows, "paper int, number int, raw string")
    primary = lists([(1, 1, "good"), (1, 2, "good"), (2, 1, "bad \ufffd"), (3, 1, "a"), (3, 3, "b"), (4, 1, "only"), (6, 1, "long"), (6, 2, "er")])
    source = lists([(1, 1, "other"), (1, 2, "x"), (1, 3, "y"), (2, 1, "fine"), (3, 1, "a"), (3, 2, "b"), (5, 1, "new"), (6, 1, "short")])
    found = {r["paper"]: (r["use"], r["warnings"]) for r in L.chosen_lists(primary, source).collect()}
    assert found == {1: ("source", []), 2: ("source", []), 3: ("source", ["noncontiguous_labels"]), 4: ("primary", []), 5: ("source", []), 6: ("primary", ["independent_bibliography_count_disagreement"])}


def test_grounding(spark):
    raw = "K. Müller, “A Fast Link,” IEEE JSSC, 2018, doi:10.1109/JSSC.2018.1234."
    rows = [(raw, "A fast link", "JSSC", "Muller", 2018, "https://doi.org/10.1109/jssc.2018.1234."), (raw, "A slow link", None, "", 2019, "10.1/x"), (None, "t", None, None, 2018, None)]
    found = L.grounded(spark.createDataFrame(rows, "raw string, title string, journal string, author string, year int, doi string")).collect()
    assert [found[0][f] for f in L.FIELDS] == ["A fast link", "JSSC", "Muller", 2018, "10.1109/jssc.2018.1234"]
    assert found[1]["warnings"] == ["title_not_in_source", "year_not_in_source", "doi_not_in_source"] and found[1]["year"] is None
    assert found[2]["title"] is None and found[2]["year"] is None


def test_votes(spark):
    reading = "struct<title:string,journal:string,author:string,year:int,doi:string,warnings:array<string>>"
    none = (None, None, None, None, None, [])
    rows = [
        (1, 1, "K. Kim, “A Link,” JSSC, 2018.", ("A Link", None, "Kim", 2018, "10.1109/1", []), ("A link x", "JSSC", "Kim", 2018, "10.1109/2", []), None),
        (1, 2, "K. Kim, A Link, JSSC, 2018.", (None, None, "Kim", 2018, None, []), ("A Link", "JSSC", "Lee", 2017, None, []), ("A Link", "JSSC", "Kim", 2018, None, ["checked"])),
        (1, 3, "K. Kim et al., ISSCC, pp. 12-13, 2018.", (None, None, "Kim", 2018, None, []), (None, "ISSCC", "Kim", 2018, None, []), None),
        (1, 4, "https://example.org/x.", none, ("T", "J", "A", 1, None, []), None),
        (1, 5, "Roadmap Report, 2018.", (None, None, None, 2018, None, []), ("Roadmap", "Roadmap", "Report", 2018, None, []), None),
        (1, 6, "some entry", none, none, None),
    ]
    df = spark.createDataFrame(rows, f"paper int, number int, raw string, rules {reading}, crf {reading}, checked {reading}")
    got = {r["number"]: r for r in L.consensus(df).collect()}
    show = lambda n: tuple(got[n][f] for f in (*L.FIELDS, "needs_check", "warnings"))
    assert show(1) == ("A Link", "JSSC", "Kim", 2018, "10.1109/1", False, [])
    assert show(2) == ("A Link", "JSSC", "Kim", 2018, None, True, ["unquoted_or_missing_title", "author_disagreement", "year_disagreement", "checked"])
    assert show(3) == (None, "ISSCC", "Kim", 2018, None, False, ["unquoted_or_missing_title", "title_absent_in_short_reference"])
    assert show(4) == (None, None, None, None, None, False, []) and got[4]["url"] == "https://example.org/x"
    assert show(5) == (None, "Roadmap", None, 2018, None, True, ["unquoted_or_missing_title", "author_disagreement", "title_equals_venue_rejected"])
    assert show(6)[5] is True and got[6]["url"] is None
