"""Weights of citations and strongest edges against plain versions, and how often pairs are shuffled."""

import random
from math import sqrt

import pytest

from foliant.operators import graph


def plain(refs, seeds):
    out, inn = {}, {}
    for a, b in refs:
        out.setdefault(a, set()).add(b)
        inn.setdefault(b, set()).add(a)
    nodes = set(out) | set(inn)
    found = set()
    for s in seeds:
        for n in nodes - {s}:
            shared = len(out.get(s, set()) & out.get(n, set()))
            co = len(inn.get(s, set()) & inn.get(n, set()))
            direct = int((s, n) in refs or (n, s) in refs)
            if shared or co or direct:
                w = 0.65 * (shared / sqrt(len(out[s]) * len(out[n])) if shared else 0) + 0.35 * (co / sqrt(len(inn[s]) * len(inn[n])) * co / (co + 2) if co else 0) + 0.12 * direct
                found.add((s, n, shared, co, direct, round(min(1.0, w), 6)))
    return found


@pytest.mark.parametrize("hub, counted", [(100_000, 2_000_000), (6, 40)])
def test_weights_equal_a_plain_version_and_pairs_are_shuffled_once(spark, monkeypatch, hub, counted):
    monkeypatch.setattr(graph, "HUB", hub, raising=False)
    monkeypatch.setattr(graph, "COUNTED", counted, raising=False)
    rng = random.Random(3)
    refs = {(rng.randrange(60), rng.randrange(60)) for _ in range(220)} | {(n, 7) for n in range(40)} | {(5, 5)}
    seeds = [1, 5, 7, 30, 99]
    found = graph.weights(spark.createDataFrame(sorted(refs), "citing long, cited long"), spark.createDataFrame([(s,) for s in seeds], "seed long"))
    rows = [(r.seed, r.node, r.shared, r.co, r.direct, round(r.weight, 6)) for r in found.collect()]
    assert set(rows) == plain(refs, seeds) and len(rows) == len(set(rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("RepartitionByExpression") == 1  # (before: two full joins and four more by pair)
    assert graph.weights(spark.createDataFrame([], "citing long, cited long"), spark.createDataFrame([(1,)], "seed long")).count() == 0


def test_strongest_edges_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANKED", 50, raising=False)
    rng = random.Random(4)
    edges = list({(rng.randrange(30), 100 + rng.randrange(30)): rng.randrange(20) / 20 for _ in range(500)}.items())
    want = set()
    for end in {x for (a, b), _ in edges for x in (a, b)}:
        mine = sorted(((-w, b if a == end else a), (a, b, w)) for (a, b), w in edges if end in (a, b))
        want |= {e for _, e in mine[:3]}
    found = graph.strongest(spark.createDataFrame([(a, b, w) for (a, b), w in edges], "a long, b long, weight double").repartition(3))
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # edges are left out before they are sorted by end
    named = graph.strongest(spark.createDataFrame([("x", "y", 0.5), ("x", "z", 0.7)], "a string, b string, weight double"), 1)
    assert {tuple(r) for r in named.collect()} == {("x", "y", 0.5), ("x", "z", 0.7)}
