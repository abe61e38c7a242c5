"""Substring, SimHash and embedding duplicates against brute force, and their defined results on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from foliant.llm import common, lattice, simhash, substring

DOCS = "doc_id long, text string, lang string, anchors string, component long"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(130)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randint(0, 160))]
        if i % 4 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = passage[rng.randint(0, 60):]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(50, rows[3][1]), (51, rows[3][1].replace(" ", "  ")), (51, rows[8][1]), (52, None), (53, ""), (None, rows[8][1]), (54, "\u0085a\x1cb c"), (55, " ".join(["x"] * 400)), (56, " ".join(["x"] * 300)), (57, rows[8][1].upper())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "clash", 7) for r in rows], DOCS)


def repeats(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [50, 7])
def test_substring_equals_brute_force(spark, width):
    rows = corpus()
    found = substring.remove_repeats(frame(spark, rows), width).collect()
    assert sorted(map(tuple, found), key=repr) == repeats(rows, width)


def test_sliding_least_is_least():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for span in (1, 2, 7, 26):
        assert substring.sliding(x, span).tolist() == [min(x[i : i + span]) for i in range(len(x) - span + 1)]


def reach(ids, link):
    label = list(ids)
    while True:
        new = [min([label[i]] + [label[j] for j in range(len(ids)) if link[i][j]]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def shingle_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_equals_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None]
    found = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    prints = [shingle_print(t) for _, t in rows]
    link = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    want = sorted((i, p, c) for (i, _), p, c in zip(rows, prints, reach([i for i, _ in rows], link)))
    assert found == want


def test_simhash_null_id_and_one_kept(spark):
    rows = corpus()
    found = simhash.near_duplicates(frame(spark, rows))
    assert found.count() == len(rows) and found.where("doc_id is null").first()["component_id"] == 8
    kept = simhash.keep_one(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 50 not in ids and 3 in ids and None in ids and kept.columns == frame(spark, rows).columns


def test_trees_meet_every_near_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**22, 3000).astype(np.uint64)
    x = np.concatenate([x, x[:500] ^ (np.uint64(1) << rng.integers(0, 22, 500).astype(np.uint64))])
    tree = simhash.Tree(x[:1000], 6, 1, rng)
    row, leaf, home = tree.route(x)
    assert sorted(row[home].tolist()) == list(range(len(x)))
    at = {}
    for r, n in zip(row.tolist(), leaf.tolist()):
        at.setdefault(r, set()).add(n)
    own = dict(zip(row[home].tolist(), leaf[home].tolist()))
    for i in range(500):
        assert own[i] in at[3000 + i] or own[3000 + i] in at[i]


def test_leaves_split_into_blocks_meet_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(simhash, "BLOCK_COLS", 16)
    rows = [r for r in corpus() if r[0] is not None]
    one = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    monkeypatch.undo()
    assert one == sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 103)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base[:20] + 0.02 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0) + 0.03 * rng.standard_normal((30, 16)), base[3:4], base[3:4] * 2.5])
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i % 11 else None) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, [], 0), (205, [1.0, 2.0], 0), (206, [1.0, 2.0], 0), (7, rows[7][1], rows[7][2])]
    return rows


def test_lattice_equals_brute_force(spark):
    rows = vectors()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    found = sorted(map(tuple, lattice.near_vectors(spark.createDataFrame(rows, schema)).collect()))
    fine = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and k is not None for _, v, k in rows]

    def linked(i, j):
        (_, a, k), (_, b, m) = rows[i], rows[j]
        if i == j or not (fine[i] and fine[j]) or k != m or len(a) != len(b):
            return False
        a, b = np.array(a), np.array(b)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    link = [[linked(i, j) for j in range(len(rows))] for i in range(len(rows))]
    comp = reach([r[0] for r in rows], link)
    assert found == sorted((r[0], sum(n), c, r[0] == c) for r, n, c in zip(rows, link, comp))


def test_e8_points_are_nearest():
    x = np.random.default_rng(3).normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    assert ((p % 2 == p[:, :1] % 2).all(axis=1) & (p.sum(axis=1) % 4 == 0)).all()
    near = ((x[:, None] * 2 - (p[:, None] + lattice.shortest_e8()[None])) ** 2).sum(axis=2).min(axis=1)
    assert (((2 * x - p) ** 2).sum(axis=1) <= near + 1e-9).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substring.remove_repeats(docs).count() == simhash.near_duplicates(docs).count() == simhash.keep_one(docs).count() == 0
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def planted():
    """Texts with copies at similarities around 0.8, a large group around one text, and a passage that many share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = word()
        return words

    texts = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):
        base = [word() for _ in range(300)]
        texts += [base, changed(base, n)]
    base, common = [word() for _ in range(200)], [word() for _ in range(60)]
    texts += [changed(base, 2) for _ in range(40)] + [common + [word() for _ in range(30)] for _ in range(30)] + [common + [word() for _ in range(3)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, rows[3][1].upper()), (1001, None), (1002, ""), (None, rows[0][1]), (1003, "a b"), (1003, "a c")]


@pytest.mark.parametrize("bounds", [{}, {"SMALL": 2, "BLOCK_ROWS": 8, "BLOCK_COLS": 16, "ORDER_SAMPLE": 0, "HUB_PAIRS": 1}])
def test_kept_equal_brute_force_at_similarity(spark, monkeypatch, bounds):
    from foliant.llm import similar

    for name, value in bounds.items():
        monkeypatch.setattr(similar, name, value)
    rows = planted()
    own = [r for r in rows if r[0] is not None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in own)]
    link = [[a == b or 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    want = {i for (i, _), c in zip(own, reach([i for i, _ in own], link)) if i == c} | {None}
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one(frame(spark, rows)).collect()) == sorted(i or -1 for i in want)
    assert 1 not in want and any(i in want for i in range(1, 20, 2))


def test_histograms_keep_every_pair_of_the_similarity():
    import numpy as np
    import pandas as pd

    from foliant.llm import similar

    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 5, 9, 15, 16, 17, 60, 64, 70, 255, 256, 300, 2000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for share in (0.8, 0.9, 1.0, 1.1, 1.25):
            own = base[: max(1, int(size * share))]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, max(0, int(size * share) - size), dtype=np.uint64)])))
        sets.append(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)))
    sets.append(np.arange(0, 400 * 2**20, 2**20, dtype=np.uint64))  # one bin holds all
    bins = [similar.histogram(h) for h in sets]
    assert bins[-1] == b"" and all(len(b) in (0, 8, 16, 32, 64, 128, 256, 512, 1024, 2048) for b in bins)
    n = len(sets)
    group = pd.DataFrame({"key": 1, "rep": range(n), "n": [len(h) for h in sets], "pos": 0, "component": range(n), "block_r": 0, "block_c": 0,
                          "is_row": True, "is_col": True, "bins": bins})
    near = [[i != j and 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = {i for i in range(n) if any(near[i])}
    found = set(similar._possible(group)["rep"])
    assert want <= found and len(found) < n
    # of one component there is nothing to compare
    assert similar._possible(group.assign(component=0)).empty
