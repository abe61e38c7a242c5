"""Concepts and abstract expansion against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.terms import technical_terms
from foliant.operators import concepts as C
from foliant.operators import text as T


@pytest.mark.parametrize("text, is_abstract, wanted", [
    ("Similar article presents required overall performance and noise reduction.", False, set()),
    ("Input–referred noise, clock and data recovery (CDR), phase interpolator.", False, {"input-referred noise", "cdr", "phase interpolator"}),
    ("Input stage with a referred signal and noise", False, set()),
    ("This TIA works without inductive peaking.", True, {"tia"}),
    ("Unlike prior work, inductive peaking was studied.", True, set()),
    ("Conventional designs use inductive peaking.", True, set()),
    ("The design avoids the use of inductive peaking.", True, set()),
    ("A charge pump free PLL", False, {"pll"}),
    ("We use inductive peaking to extend the bandwidth.", True, {"inductive peaking"}),
    ("Protection withstands 4-kV HBM ESD stress.", False, {"electrostatic discharge"}),
    ("A 1.2V HBM memory interface.", False, {"hbm"}),
    ("", True, set()),
])
def test_concepts_are_grounded(text, is_abstract, wanted):
    assert set(C.concepts_in(C.lowered(text), is_abstract)) == wanted


def plain(papers, shown, most):
    """The same search by loops over seeds and titles."""
    ids = [i for i, *_ in papers]
    names = {i: set(C.concepts_in(C.lowered(t), False)) for i, t, _, _, _, _ in papers}
    domains = {i: C.domains_of(C.lowered(t)) for i, t, *_ in papers}
    terms, identity = {i: set(x or []) for i, _, _, _, x, _ in papers}, {i: d for i, _, _, _, _, d in papers}
    n = len(papers)
    df = lambda sets: {k: sum(k in s for s in sets.values()) for k in set().union(*sets.values())}
    weight = lambda counts: {k: 1 + math.log((n + 1) / (c + 1)) for k, c in counts.items()}
    wc, wt = weight(df(names)), weight(df(terms))
    title = {i: t for i, t, *_ in papers}
    used = {i for i, _, _, s, _, _ in papers if s} | set(shown)
    keys = {identity[i]["t"] for i in used}
    queues, best, support = [], {}, {}
    for i, _, abstract, seed, _, _ in sorted(papers):
        if not seed or not (abstract or "").strip():
            continue
        said = C.concepts_in(C.lowered(abstract), True)
        extra = sorted((c for c in said if c not in names[i] and c in wc), key=lambda c: (-wc[c], c))[:8]
        query = {c: 1.0 for c in names[i]} | {c: 0.55 for c in extra}
        ranked = []
        for j in ids:
            added, anchors = sorted(set(extra) & names[j]), sorted(names[i] & names[j])
            if j in used or not added or identity[j]["t"] in keys:
                continue
            rest = C.ANY_CONCEPT.sub(lambda m: " " if C.NAMES[int(m.lastgroup[1:])] in added else m[0], C.lowered(title[j]))
            context = sorted(C.domains_of(rest) & domains[i]) if not anchors and domains[i] & domains[j] else []
            if not anchors and not context:
                continue
            long = lambda s, w: math.sqrt(sum(w[k] ** 2 for k in s))
            lexical = sum(wt[k] ** 2 for k in terms[i] & terms[j]) / max(1e-9, long(terms[i], wt) * long(terms[j], wt))
            meant = sum(wc[c] ** 2 * query[c] for c in names[j] & set(query)) / (math.sqrt(sum((wc.get(c, 1) * q) ** 2 for c, q in query.items())) * long(names[j], wc))
            score = 0.65 * lexical + 0.35 * meant
            if score >= 0.18:
                ranked.append((-score, j, added, anchors, context))
        queue = sorted(ranked)[:8]
        for s, j, added, anchors, context in queue:
            support[j] = support.get(j, 0) + 1
            if j not in best or -s > best[j][0]:
                best[j] = (-s, i, added, anchors, context, {c: said[c] for c in added})
        queues.append([j for _, j, *_ in queue])
    out, seen = [], set()
    for depth in range(8):
        for queue in queues:
            if depth < len(queue) and len(out) < most and queue[depth] not in seen:
                j = queue[depth]
                seen.add(j)
                if identity[j]["t"] not in keys:
                    keys.add(identity[j]["t"])
                    out.append((j, len(out) + 1, round(best[j][0], 4), *best[j][1:], support[j]))
    return out


def test_expansion_equals_a_plain_version(spark):
    rng = random.Random(4)
    bits = ["TIA", "VCSEL", "CDR", "charge pump", "inductive peaking", "phase interpolator", "photodiode", "HBM memory", "DFE", "ring oscillator", "optical link", "wireline", "sensor", "amplifier", "in 28-nm CMOS"]
    rows = []
    for i in range(90):
        t = " ".join(rng.sample(bits, rng.randint(1, 4))) + f" {'alpha beta gamma delta'.split()[i % 4]} {i % 41}"
        a = ". ".join(f"{rng.choice(['We use', 'Unlike prior', 'It works without', 'There is'])} {rng.choice(bits)}" for _ in range(4))
        rows.append((i, t, rng.choice([a, a, a, "", None]), i % 9 == 0))
    rows += [(200, None, None, False), (201, "", "TIA", True), (202, rows[1][1], None, False), (202, rows[1][1] + "x", None, False)]
    rows = rows[:-1]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, title string, abstract string, seed boolean, key string, depth int").repartition(5)
    shown = spark.createDataFrame([(5,), (6,)], "id long")
    extra = {r["id"]: r for r in df.select("id", technical_terms(F.col("title")).alias("terms"), T.title_identity(F.col("title")).alias("d")).collect()}
    papers = [(i, t or "", a, s, extra[i]["terms"], extra[i]["d"].asDict() if t is not None else {"t": None}) for i, t, a, s in rows]
    for most in (1500, 3):
        found = C.expanded(df, "id", "title", "abstract", F.col("seed"), shown, most).orderBy("place").collect()
        got = [(r["id"], r["place"], r["score"], r["seed"], r["added"], r["anchors"], r["context"], r["evidence"], r["support"]) for r in found]
        want = plain(papers, [5, 6], most)
        assert len(want) == min(most, len(want)) > 2
        assert got == [pytest.approx(w) if isinstance(w, float) else w for w in want]
    assert C.expanded(df.limit(0), "id", "title", "abstract", F.col("seed"), shown).count() == 0


def lead(spark, seed, candidates, abstract):
    rows = [(1, seed, abstract, True)] + [(i + 2, c, None, False) for i, c in enumerate(candidates)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string, seed boolean")
    return C.expanded(df, "id", "title", "abstract", F.col("seed"), df.select("id").limit(0)).collect()


def test_known_leads(spark):
    good = lead(spark, "High-Performance CMOS TIA for Data Center Optical Interconnects", ["A 2 pA Input-Referred Noise TIA in 180-nm CMOS With 2.5 GHz Bandwidth for Optical Receiver"], "The input-referred noise of the TIA is measured in the optical receiver.")
    assert good[0]["added"] == ["input-referred noise"] and "tia" in good[0]["anchors"] and good[0]["evidence"] == {"input-referred noise": "input-referred noise"}
    assert not lead(spark, "High-Performance CMOS TIA for Optical Interconnects", ["Input-Referred Noise in Biomedical Electrocardiogram Amplifiers"], "The circuit reduces input-referred noise.")
    assert not lead(spark, "Optical Link for Data Centers", ["Photodiode Design and Optimization"], "A photodiode is integrated in this optical link.")


def test_short_titles_are_near(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefghi"), (3, "abcdefg"), (4, "abcdXefgh"), (5, "zzzzzzzz")], "id long, t string")
    found = {(r["a"], r["b"]) for r in T.same_titles(df, "id", "t").collect()}
    assert found == {(1, 2), (1, 4)}


def test_blocks_change_nothing(spark, monkeypatch):
    bits = ["TIA", "VCSEL", "CDR", "charge pump", "photodiode", "DFE", "optical link", "wireline"]
    rows = [(i, f"{bits[i % 8]} {bits[i * 3 % 7]} {bits[i % 5]} {i % 6}", f"We use {bits[i % 7]}. There is {bits[i % 4]}.", i % 7 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string, seed boolean")
    found = lambda: [tuple(r) for r in C.expanded(df, "id", "title", "abstract", F.col("seed"), df.select("id").limit(0)).orderBy("place").collect()]
    whole = found()
    assert len(whole) > 10
    for name, value in (("TITLES", 9), ("SEEDS", 5), ("AT_ONCE", 2)):
        monkeypatch.setattr(C, name, value)
    assert found() == whole
