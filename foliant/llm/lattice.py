"""Embedding near-duplicates by E8 lattice hashing, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, block_pairs, components, cut, table
from .topk import valid

THRESHOLD = 0.98
#: Tables, neighbouring cells probed in each, and the lattice's scale against unit vectors of 64 dimensions.
TABLES, PROBES, SCALE, SEED = 3, 6, 2.2, 17
#: Largest block of a cell that one task compares, and rows that one task gets in about.
BLOCK_ROWS, BLOCK_COLS, TASK_ROWS = 1024, 4096, 512


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of the E8 lattice to each row of ``x`` (n, 8), in half units (so as integers)."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = r.sum(axis=1).astype(np.int64) & 1 == 1
        gap = y - r
        worst = np.abs(gap).argmax(axis=1)
        rows = np.flatnonzero(odd)
        r[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8 in half units: (+-2, +-2, 0...) and (+-1)^8 with an even number of minuses."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            pairs.append(v)
    return np.array(pairs + [list(v) for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0], dtype=np.int64)


_SHORTEST = shortest_e8()
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _cell(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point (last axis: 8 coordinates). Names that collide cost comparisons only."""
    with np.errstate(over="ignore"):
        h = (points.astype(np.uint64) * _MIX).sum(axis=-1, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """(n, tables, 1 + probes) cell names of unit vectors: the own cell first, then the nearest neighbouring ones."""
    n, dims = unit.shape
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        rng = np.random.default_rng((SEED, dims, t))
        base = rng.standard_normal((dims, 8))
        base = np.linalg.qr(base)[0] if dims >= 8 else base / np.sqrt(8)
        x = unit @ base * (scale * np.sqrt(max(dims, 8) / 8)) + rng.random(8)
        own = nearest_e8(x)
        gap = 2 * x - own
        # the squared distance to own + v is |gap|^2 - 2 gap.v + |v|^2, and |v|^2 is the same for all
        near = np.argsort(-(gap @ _SHORTEST.T), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell(own)
        out[:, t, 1:] = _cell(own[:, None, :] + _SHORTEST[near])
    return out


def _meets(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of rows meet in table ``t``: one's own cell is the other's own or probed cell."""
    hit = np.zeros((len(a), len(b)), dtype=bool)
    for p in range(a.shape[2]):
        hit |= a[:, None, t, 0] == b[None, :, t, p]
        hit |= a[:, None, t, p] == b[None, :, t, 0]
    return hit


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row ``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, label)``.

    Links join vectors of one label, not null, whose cosine in double precision is ``threshold`` or more. Vectors that
    are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing. Repeated
    vectors are one class while cells are compared and count as often as they occur in ``n_links``. Every row is
    returned, those without a vec_id with null component and kept. An empty table gives no rows.

    Each class lives in its own cell of every table and visits the neighbouring ones. Cells of any size are compared in
    blocks; a pair is counted in the first table where it meets, so that counts need no list of all pairs, and every
    block returns counts and a spanning forest of its links.
    """
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid(F.col("embedding"))
    usable = usable & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = cut(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                size = np.array([len(v) for v in b.column("embedding")])
                for dims in np.unique(size).tolist():
                    some = b.take(pa.array(np.flatnonzero(size == dims)))
                    keys = cells(_unit(some.column("embedding").flatten().to_numpy(zero_copy_only=False), dims))
                    n, tables, wide = keys.shape
                    yield pa.RecordBatch.from_arrays(
                        [some.column("label").cast(pa.int64()), pa.array([dims] * n, pa.int32()), some.column("rep"), some.column("many"), some.column("embedding").cast(pa.list_(pa.float64())), pa.array(keys.reshape(n, -1).tolist(), pa.list_(pa.int64()))],
                        names=["label", "dims", "rep", "many", "vector", "keys"])

    # the vectors travel only to cells where some vector lives and another one comes by
    keyed = cut(classes.mapInArrow(route, "label long, dims int, rep long, many long, vector array<double>, keys array<long>"))
    cell = ["label", "dims", "tab", "cell"]
    routes = keyed.select("label", "dims", "rep", F.posexplode("keys").alias("at", "cell")).select(
        "label", "dims", "rep", F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("tab"), "cell", (F.col("at") % (1 + PROBES) == 0).alias("resident"))
    busy = routes.groupBy(*cell).agg(F.count("*").alias("_all"), F.count_if("resident").alias("_home")).where("_home > 0 and _all > 1").select(*cell)
    blocks = cut(block_pairs(routes.join(busy, cell, "left_semi"), cell, "rep", BLOCK_ROWS, BLOCK_COLS))
    tasks = max(1, blocks.count() // TASK_ROWS)
    blocks = blocks.withColumn("task", F.pmod(F.xxhash64(*cell, "block_r", "block_c"), F.lit(tasks)).cast("int"))
    blocks = blocks.join(keyed.select("rep", "many", "vector", "keys"), "rep")

    def compare(group):
        import pandas as pd

        out = [_compare_cell(g, threshold) for _, g in group.groupby(["label", "dims", "tab", "cell", "block_r", "block_c"], sort=False)]
        return pd.concat(out).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = cut(blocks.groupBy("task").applyInPandas(compare, "a long, b long, n long"))
    reach = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.join(links, classes.rep == links.a, "left").join(reach, classes.rep == reach.node, "left")
    known = known.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("usable").join(cut(known), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(values: np.ndarray, dims: int) -> np.ndarray:
    x = values.astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare_cell(group, threshold: float):
    """Counts ``a, n`` and forest edges ``a, b`` of one block of one cell."""
    import pandas as pd

    t, dims = int(group["tab"].iloc[0]), int(group["dims"].iloc[0])
    rep, many = group["rep"].to_numpy(), group["many"].to_numpy()
    forest, count = Forest(len(rep)), {}
    rows, cols = np.flatnonzero(group["is_row"].to_numpy()), np.flatnonzero(group["is_col"].to_numpy())
    if len(rows) and len(cols):
        x = np.stack(group["vector"].to_list())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        keys = np.stack(group["keys"].to_list()).reshape(len(x), TABLES, 1 + PROBES)
        home = keys[:, t, 0] == int(group["cell"].iloc[0])
    for at in range(0, len(rows) if len(cols) else 0, 256):
        some = rows[at : at + 256]
        hit = (x[some] @ x[cols].T) / (norm[some][:, None] * norm[cols][None, :]) >= threshold
        hit &= rep[cols][None, :] != rep[some][:, None]
        r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if not len(r):
            continue
        hit = hit[np.ix_(r, c)]
        a, b = some[r], cols[c]
        for i in range(len(r)):
            forest.link(int(a[i]), b[hit[i]])
        for before in range(t):
            hit &= ~_meets(keys[a], keys[b], before)
        # a resident and a visitor may meet in the visitor's own cell as well: one of the two counts them
        both_home = np.broadcast_to(home[b][None, :], hit.shape)
        visits = np.zeros_like(hit)
        for p in range(1, keys.shape[2]):
            visits |= keys[a][:, None, t, p] == keys[b][None, :, t, 0]
        hit &= both_home | ~visits | (rep[a][:, None] < rep[b][None, :])
        for i, n in enumerate((hit * many[b][None, :]).sum(axis=1).tolist()):
            count[rep[a[i]]] = count.get(rep[a[i]], 0) + n
        # residents are rows themselves; a visitor is never a row here, so its links are counted for it
        for j, n in enumerate(((hit & ~both_home) * many[a][:, None]).sum(axis=0).tolist()):
            count[rep[b[j]]] = count.get(rep[b[j]], 0) + n
    out = pd.DataFrame({"a": list(count), "b": [None] * len(count), "n": list(count.values())})
    edges = pd.DataFrame({"a": [rep[i] for i, _ in forest.edges], "b": [rep[j] for _, j in forest.edges], "n": [0] * len(forest.edges)})
    return pd.concat([x.astype({"a": "int64", "b": "Int64", "n": "int64"}) for x in (out, edges)])


def op6_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
