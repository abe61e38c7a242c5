"""Lineages against a plain walk, with cycles, hubs and caps."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import lineage


def plain(nodes, edges, root, depth, limit, directions, wanted):
    inn, out = {}, {}
    for s, t in edges:
        if s != t and s in nodes and t in nodes:
            inn.setdefault(t, set()).add(s)
            out.setdefault(s, set()).add(t)

    def walk(near, on):
        found, parent, queue = {root: 0}, {}, [root]
        for at in queue if on else []:
            if found[at] < depth:
                for n in sorted(near.get(at, ())):
                    if n not in found:
                        found[n], parent[n] = found[at] + 1, at
                        queue.append(n)
        return found, parent

    trees = [walk(inn, "prior" in directions), walk(out, "derivative" in directions)]
    every = set(trees[0][0]) | set(trees[1][0])
    nearest = {n: min(t[0].get(n, 99) for t in trees) for n in every}
    ranked = sorted((n for n in every if n == root or n in wanted), key=lambda n: (nearest[n], -(nodes[n] or 0), n))
    queues = [(p, [n for n in ranked if f.get(n) == level]) for level in range(1, depth + 1) for f, p in trees]
    kept, moved = {root}, True
    while len(kept) < limit and moved:
        moved = False
        for parent, queue in queues:
            while queue:
                n = queue.pop(0)
                if n in kept:
                    continue
                path, k = [], n
                while k is not None and k not in kept:
                    if k in ranked:
                        path.append(k)
                    k = parent.get(k)
                if len(kept) + len(path) > limit:
                    continue
                kept |= set(path)
                moved = True
                break
            if len(kept) >= limit:
                break
    return {(root, n, nearest[n], trees[0][0].get(n), trees[1][0].get(n)) for n in kept}


@pytest.mark.parametrize("depth, limit, directions, some", [(3, 4, ("prior", "derivative"), 1.0), (3, 7, ("prior", "derivative"), 0.6), (2, 30, ("prior",), 1.0), (3, 60, ("prior", "derivative"), 0.5), (1, 1, ("derivative",), 1.0), (3, 5, ("derivative",), 0.3)])
def test_lineage_equals_a_plain_walk(spark, depth, limit, directions, some):
    rng = random.Random(limit)
    nodes = {i: rng.choice([None, 0, 1, 5, 9]) for i in range(120)}
    edges = [(rng.randrange(125), rng.randrange(125)) for _ in range(260)] + [(0, i) for i in range(1, 60)] + [(1, 2), (2, 1), (3, 3), (1, 2)]
    wanted = {n for n in nodes if rng.random() < some}
    roots = [0, 1, 5, 7, 100, 124]
    df = spark.createDataFrame([(n, c, n in wanted) for n, c in nodes.items()], "node long, cited int, w boolean")
    e = spark.createDataFrame([(*x, "z") for x in edges], "source long, target long, root string")
    found = lineage.explored(e, df, spark.createDataFrame([(r,) for r in roots], "root long"), depth, limit, directions, F.col("w")).collect()
    want = set().union(*(plain(nodes, edges, r, depth, limit, directions, wanted) for r in roots if r in nodes))
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_edges_between_the_chosen(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "node long, cited int")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 1), (3, 4)], "source long, target long")
    roots = spark.createDataFrame([(0,)], "root long")
    chosen = lineage.explored(e, df, roots)
    assert {tuple(r) for r in lineage.between(e, chosen).collect()} == {(0, 0, 1), (0, 1, 2), (0, 2, 0)}
    assert [tuple(r) for r in lineage.explored(e.limit(0), df, roots).collect()] == [(0, 0, 0, 0, 0)]
    assert lineage.explored(e, df, roots.limit(0)).count() == 0


def test_levels_that_reach_nothing_end_a_tree(spark, monkeypatch):
    asked = []
    real = lineage.bounded
    monkeypatch.setattr(lineage, "bounded", lambda keys: asked.append(keys.columns[0]) or real(keys))
    e = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (0, 3)], "source long, target long")
    nodes = spark.createDataFrame([(i, None) for i in range(3)], "node long, cited int")
    found = lineage.reached(e, nodes, spark.createDataFrame([(0,), (0,), (8,)], "root long"))
    assert sorted((r.tree, r.node, r.level, r.path) for r in found.collect()) == [("derivative", 0, 0, []), ("prior", 0, 0, []), ("prior", 1, 1, [1]), ("prior", 2, 1, [2])]
    # the prior tree reads its edges for two levels, the derivative one, whose only edge leads to an unknown node, for one
    assert asked.count("at") == 3
