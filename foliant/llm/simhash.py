"""SimHash near-duplicate detection with vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, block_pairs, bounded, components, cut, slices, table

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Residents of a leaf that the depth of a tree aims at; sampled fingerprints a leaf; deepest tree.
LEAF, SAMPLES_A_LEAF, DEEPEST = 1024, 16, 16
#: Largest block of a leaf that one task compares.
BLOCK_ROWS, BLOCK_COLS = 8192, 65536
#: The 64 bits fall into three parts: two fingerprints within 4 bits are within 1 bit in one of them.
PARTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of ``text`` as an unsigned int; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    width = min(SHINGLE, len(words))
    starts = (end - size)[: len(words) - width + 1].tolist()
    ends = end[width - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 32768):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + 32768], ends[at : at + 32768])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, fp`` (fp as a signed long) for every row of ``docs``; null text counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Tree:
    """A complete vantage-point tree over one part of the bits, fitted to a sample.

    Node k has children 2k+1 (distance to its vantage point <= its cut) and 2k+2 (beyond it).
    """

    def __init__(self, sample: np.ndarray, depth: int, radius: int, rng: np.random.Generator):
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros(max(1, 2**depth - 1), dtype=np.uint64)
        self.cut = np.full(max(1, 2**depth - 1), 64, dtype=np.int64)
        self._fit(0, 0, sample, rng)

    def _fit(self, node: int, level: int, s: np.ndarray, rng: np.random.Generator) -> None:
        if level == self.depth or len(s) < 2:
            return
        best = None
        for v in rng.choice(s, 4):  # of a few vantage points, the one whose cut has the fewest rows near it
            d = np.bitwise_count(s ^ v).astype(np.int64)
            at = int(np.sort(d)[(len(d) - 1) // 2])
            for c in (at, at - 1):
                left = int((d <= c).sum())
                if 0 < left < len(d):
                    cost = abs(left / len(d) - 0.5) + ((d > c - self.radius) & (d <= c + self.radius)).mean()
                    if best is None or cost < best[0]:
                        best = (cost, v, c, d)
        if best is None:
            return
        _, self.vantage[node], self.cut[node], d = best
        self._fit(2 * node + 1, level + 1, s[d <= self.cut[node]], rng)
        self._fit(2 * node + 2, level + 1, s[d > self.cut[node]], rng)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether the row lives there; a row visits a leaf unless a triangle bound rules it out."""
        row, node = np.arange(len(values)), np.zeros(len(values), dtype=np.int64)
        home = np.ones(len(values), dtype=bool)
        for _ in range(self.depth):
            d = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int64)
            c = self.cut[node]
            inside = d <= c
            # the boundary is met from outside alone: a pair across it meets where its inner row lives
            left = np.where(home, inside, d <= c + self.radius)
            right = np.where(home, ~inside, d > c - self.radius)
            over = home & ~inside & (d <= c + self.radius)
            row = np.concatenate([row[left], row[right], row[over]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[over] + 1])
            home = np.concatenate([home[left], home[right], np.zeros(int(over.sum()), dtype=bool)])
        return row, node, home


def part(values: np.ndarray, k: int) -> np.ndarray:
    shift, width = PARTS[k]
    return (values >> np.uint64(shift)) & np.uint64(2**width - 1)


def links(classes: DataFrame) -> DataFrame:
    """Edges ``a, b`` between the ids of ``classes(rep, fp)`` (one row per fingerprint) that connect exactly
    what pairs at 4 or fewer differing bits connect.

    One vantage-point tree per part of the bits, radius 1. Trees are fitted on the driver to a bounded sample
    (16 fingerprints a leaf, 2^16 leaves at most, so 8 MB); every fingerprint is then routed by them. A leaf
    returns a spanning forest of its links, so a group of n near copies gives n - 1 edges and not n^2.
    """
    spark = classes.sparkSession
    n = classes.count()
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, n) / LEAF)))))
    wanted = SAMPLES_A_LEAF * 2**depth
    part_sample = classes.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1_000_000)) < F.lit(int(min(1.0, 1.2 * wanted / max(1, n)) * 1_000_000)))
    sample = np.array([r[0] for r in part_sample.select("fp").limit(wanted).collect()], dtype=np.int64).view(np.uint64)
    rng = np.random.default_rng(11)
    trees = [Tree(part(sample, k), depth, 1, rng) for k in range(len(PARTS))]
    trees = spark.sparkContext.broadcast([(t.vantage, t.cut) for t in trees])

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            for k, (vantage, cuts) in enumerate(trees.value):
                t = Tree.__new__(Tree)
                t.depth, t.radius, t.vantage, t.cut = depth, 1, vantage, cuts
                row, leaf, home = t.route(part(fp.view(np.uint64), k))
                for at in range(0, len(row), 100_000):
                    r, le, ho = row[at : at + 100_000], leaf[at : at + 100_000], home[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k, dtype=np.int32)), pa.array(le), pa.array(rep[r]), pa.array(fp[r]), pa.array(ho)], names=["tree", "leaf", "rep", "fp", "resident"])

    routes = classes.select("rep", "fp").mapInArrow(route, "tree int, leaf long, rep long, fp long, resident boolean")
    blocks = block_pairs(routes, ["tree", "leaf"], "rep", BLOCK_ROWS, BLOCK_COLS)
    return blocks.groupBy("tree", "leaf", "block_r", "block_c").applyInPandas(_forest, "a long, b long").distinct()


def _forest(group):
    import pandas as pd

    fp = group["fp"].to_numpy().view(np.uint64)
    rep = group["rep"].to_numpy()
    cols = np.flatnonzero(group["is_col"].to_numpy())
    forest = Forest(len(fp))
    rows = np.flatnonzero(group["is_row"].to_numpy())
    step = max(1, 4_000_000 // max(1, len(cols)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        near = np.bitwise_count(fp[some][:, None] ^ fp[cols][None, :]) <= RADIUS
        near &= cols[None, :] != some[:, None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            forest.link(int(some[i]), cols[near[i]])
    return pd.DataFrame({"a": [rep[i] for i, _ in forest.edges], "b": [rep[j] for _, j in forest.edges]}, dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row ``doc_id, fp, component_id`` per row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over fingerprints within 4 bits, the document's own included.
    Null and empty texts have fingerprint 0 and link like any other. Rows whose doc_id is null get the component
    of their fingerprint, null if no row with an id has it or a linked one. Repeated rows are returned each; an
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    fps = cut(with_fingerprint(docs))
    classes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes))
    known = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(cut(known), "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one whose doc_id is the smallest.

    Groups are what pairs of a similarity of 0.8 or more connect (see ``similar.linked``). Rows without a doc_id are
    kept: they name no document that could stand for them. Repeated rows of one doc_id count as copies, so one of them
    stays, which is picked by a hash of the text. Columns of any name go along.
    """
    from .similar import linked

    found = linked(docs)
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("gone")).agg(F.count("*").alias("rows"))
    # losers are few, so their ids are broadcast if that is measured to be so, and texts are shuffled only beyond it
    gone = bounded(ids.join(found.where("rep = component").select(F.col("rep").alias("gone")), "gone", "left_anti").select("gone"))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    again = cut(ids.where("rows > 1").select(F.col("gone").alias("again")))
    if again.isEmpty():
        return kept
    again = bounded(again)
    same = kept["doc_id"].cast("long") == again["again"]
    twice = kept.join(again, same, "left_semi")
    row = F.struct(*[twice[c] for c in twice.columns])
    one = twice.groupBy(twice["doc_id"]).agg(F.min_by(row, F.struct(F.xxhash64("text"), F.col("text"))).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").unionByName(one)
