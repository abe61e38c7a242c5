"""Staged matches against a plain version."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from foliant.operators import matching

ALIASES = {"VLSI": ["VLSI-Circuits", "VLSI-Tech"], "ISSCC": ["ISSCC", "JSSC"]}


def key(t):
    return " ".join(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in ("a", "an", "the"))


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split()), set(b.split())
    return 0.62 * SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.38 * len(x & y) / len(x | y)


def plain(record, papers, threshold, margin, floor):
    _, title, year, venue = record
    if year is None or venue is None:
        return None, "unmatched", 0.0, 0.0
    names = [v.upper() for v in {k.upper(): v for k, v in ALIASES.items()}.get(venue.strip().upper(), [venue.strip()])]
    usable = [(p, key(t), y, v.strip().upper()) for p, t, y, v in papers if y is not None and v is not None]
    pool = [p for p in usable if p[2] == year and p[3] in names]
    exact = [p for p in pool if p[1] == key(title)]
    if len(exact) == 1:
        return exact[0][0], "exact_title_year_venue", 1.0, 1.0
    near = [p for p in usable if p[3] in names and p[1] == key(title) and abs(p[2] - year) <= 1]
    if len(near) == 1:
        return near[0][0], "exact_title_venue_year_offset", 0.99, 1.0
    scored = sorted(((similarity(key(title), p[1]), -p[0]) for p in pool), reverse=True)
    scored = [s for s in scored if s[0] >= floor]
    if not scored:
        return None, "unmatched", 0.0, 0.0
    best, lead = scored[0], scored[0][0] - (scored[1][0] if len(scored) > 1 else 0.0)
    method = "fuzzy_title_year_venue" if best[0] >= threshold and lead >= margin else "ambiguous" if best[0] >= threshold else "unmatched"
    return -best[1], method, round(best[0], 6), round(lead, 6)


def test_passes_equal_a_plain_version(spark):
    rng = random.Random(6)
    words = "high speed link receiver transmitter with adaptive equalizer the a low power clock recovery 28nm cmos optical driver for memory interfaces and data".split()
    titles = [" ".join(rng.choices(words, k=rng.randint(6, 14))) for _ in range(60)]

    def changed(t):
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w[i] = rng.choice([w[i] + "s", w[i].upper(), rng.choice(words)])
        return " ".join(w)

    papers = [(i, changed(rng.choice(titles)), rng.choice([2020, 2021, 2022]), rng.choice(["VLSI-Circuits", "JSSC", "isscc", "CICC"])) for i in range(400)]
    papers += [(900, None, 2020, "JSSC"), (901, titles[0], None, "JSSC"), (902, titles[0], 2020, None), (903, "", 2021, "CICC")]
    records = [(i, changed(rng.choice(titles)), rng.choice([2020, 2021, 2022, 2023]), rng.choice(["VLSI", "ISSCC", "cicc ", "JSSC"])) for i in range(300)]
    records += [(900, None, 2021, "CICC"), (901, titles[0], None, "JSSC"), (902, titles[1], 2020, None), (0, *records[0][1:]), (903, "<b>The</b> &amp; $x$", 2020, "JSSC")]
    as_frame = lambda rows, name: spark.createDataFrame([(*r, "x", 1) for r in rows], f"{name} long, title string, year int, venue string, said string, n int").repartition(3)
    for threshold, margin, floor in ((0.94, 0.025, 0.9), (0.86, 0.0, 0.7)):
        found = matching.staged(as_frame(records, "record"), as_frame(papers, "paper"), ALIASES, threshold, margin, floor=floor).collect()
        got = sorted((r["record"], -1 if r["paper"] is None else r["paper"], r["method"], r["score"], r["margin"]) for r in found)
        want = sorted((r[0], *(x if x is not None else -1 for x in plain(r, papers, threshold, margin, floor))) for r in records[:-1])
        want = sorted([*want, (903, -1, "unmatched", 0.0, 0.0)])
        assert got == want
        assert len({m for _, _, m, _, _ in want}) >= 4
    assert matching.staged(as_frame([], "record"), as_frame(papers, "paper"), {}).count() == 0
    assert matching.staged(as_frame(records[:3], "record"), as_frame([], "paper"), {}).count() == 3


def test_similarity(spark):
    df = spark.createDataFrame([("The Fast Link", "fast link"), ("", "x"), ("fast links", "fast link")], "a string, b string")
    found = [r[0] for r in df.select(matching.key_similarity(matching.title_key(F.col("a")), matching.title_key(F.col("b")))).collect()]
    assert found[:2] == [1.0, 0.0] and abs(found[2] - similarity("fast links", "fast link")) < 1e-12


def test_words_rule_pairs_out_before_they_are_shuffled(spark):
    rng = random.Random(9)
    keys = [(2020, "X", " ".join(rng.sample("abcdefghij", rng.randint(3, 9)))) for _ in range(80)]
    df = spark.createDataFrame(keys, "year int, venue string, key string").distinct()
    met = {(r["key"], r["other"]) for r in matching._near(df, df, 0.9).collect()}
    share = (0.9 - matching.ORDER_SHARE) / matching.WORD_SHARE
    texts = {k for *_, k in keys}
    jaccard = lambda x, y: len(set(x) & set(y) - {" "}) / len((set(x) | set(y)) - {" "})
    near = {(x, y) for x in texts for y in texts if jaccard(x, y) >= share}
    assert near <= met and len(met) <= 1.5 * len(near)
