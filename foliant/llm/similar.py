"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: fingerprints, then an exact join.

At a similarity of 0.8 two 64-bit fingerprints differ in some 10 bits, often in 17 or more, a radius at which a tree of
fingerprints rules out next to nothing. So fingerprints within 4 bits give the first candidates, which link most copies
cheaply, and prefixes of the shingle sets give all others. Every candidate is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, block_pairs, bounded, components, cut, remove, slices, written
from .simhash import SEED, links

WIDTH = 5
#: Documents sampled for the order of shingles, and the most frequent shingles it puts last. Both steer the cost alone.
ORDER_SAMPLE, ORDER_LAST = 5_000, 65_536
#: Buckets of up to this many documents give all their pairs at once; larger ones are linked through HUBS documents first.
SMALL, HUBS = 16, 4
#: Largest block of a bucket that one task compares.
BLOCK_ROWS, BLOCK_COLS = 1024, 2048
#: Bins (powers of two) of a set's histogram; it has about as many as the set has shingles. They steer the cost alone.
LEAST_BINS, MOST_BINS = 8, 16_384
#: Pairs from which on those of one document are spread, and over so many tasks.
HUB_PAIRS, SALTS = 1024, 64
#: The similarity as integers: |a & b| / |a | b| >= 4/5 is 9 |a & b| >= 4 (|a| + |b|).
_LONG_ENOUGH = "least(na, nb) * 5 >= greatest(na, nb) * 4"
_MAY_REACH = "9 * least(na - pa, nb - pb) >= 4 * (na + nb)"


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all shingles of ``width`` words in order, of the whole text if it is shorter; no words: none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    width = min(width, len(words))
    starts = (end - size)[: len(words) - width + 1].tolist()
    ends = end[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=len(starts))


def folded(h: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes as an unsigned int; none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 32768):
        bits = np.unpackbits(h[at : at + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _last(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles frequent in a bounded sample, and their places at the end of the order."""
    share = int(min(1.0, 1.2 * ORDER_SAMPLE / max(1, docs.count())) * 1_000_000)
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < share)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                own = [np.unique(hashes(t.as_py())) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["key"])

    counts = some.select("text").mapInArrow(run, "key long").groupBy("key").count().where("count > 2")
    found = np.array([r[0] for r in counts.orderBy(F.desc("count"), "key").limit(ORDER_LAST).collect()], dtype=np.int64).view(np.uint64)
    by = np.argsort(found)
    return found[by], len(found) - by


def prefix(h: np.ndarray, last: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first |h| - ceil(0.8 |h|) + 1 of a set of hashes in the order; sets of similarity 0.8 share one in it."""
    place = np.zeros(len(h), dtype=np.int64)
    if len(last):
        at = np.minimum(np.searchsorted(last, h), len(last) - 1)
        place = np.where(last[at] == h, places[at], 0)
    return h[np.lexsort((h, place))][: len(h) - (4 * len(h) + 4) // 5 + 1]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """One row ``doc_id, fp, sig, n, prefix`` per row of ``docs``, as a table and its path; sig names the set of n shingles."""
    order = docs.sparkSession.sparkContext.broadcast(_last(docs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for b in slices(batch, "text"):
                fps, sigs, sizes, heads = [], [], [], []
                for t in b.column("text"):
                    h = hashes(t.as_py())
                    own = np.unique(h)
                    fps.append(folded(h))
                    sigs.append(xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    heads.append(prefix(own, *order.value).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64))
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                columns = [b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))], names=["doc_id", "fp", "sig", "n", "prefix"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, sig binary, n int, prefix array<long>"))


def histogram(h: np.ndarray) -> bytes:
    """How many of a set of hashes fall into each bin, a byte a bin; nothing if a bin holds more than a byte can say."""
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << max(0, len(h).bit_length() - 1)))
    many = np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return many.astype(np.uint8).tobytes() if many.max() <= 255 else b""


def _wanted(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows ``rep, text`` of the documents in ``reps(rep)``."""
    return docs.select(F.col("doc_id").alias("rep"), "text").join(bounded(reps.select("rep").distinct()), "rep", "left_semi")


def _sets(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, str]:
    """Rows ``rep, h`` with the sorted shingle hashes of the documents in ``reps(rep)``, as a table and its path."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                own = [np.unique(hashes(t.as_py())).view(np.int64) for t in b.column("text")]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["rep", "h"])

    return written(_wanted(docs, reps).mapInArrow(run, "rep long, h array<long>"))


def _histograms(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows ``rep, bins`` with the histograms of the documents in ``reps(rep)``: an eighth of their sets in size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                own = [histogram(np.unique(hashes(t.as_py()))) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(own, pa.binary())], names=["rep", "bins"])

    return _wanted(docs, reps).mapInArrow(run, "rep long, bins binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``sets(rep, h)`` have a similarity of 0.8 or more.

    The set of ``a`` travels once for all its pairs; those of an ``a`` with more than HUB_PAIRS are spread over SALTS tasks.
    """
    hubs = pairs.groupBy("a").count().where(F.col("count") > HUB_PAIRS).select("a", F.lit(SALTS).alias("salts"))
    pairs = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("part"))
    one = pairs.select("a", "part").distinct().join(sets.select(F.col("rep").alias("a"), F.col("h").alias("ha")), "a")
    two = pairs.join(sets.select(F.col("rep").alias("b"), F.col("h").alias("hb")), "b")
    both = two.join(one, ["a", "part"])
    return cut(both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b").distinct())


def _partners(g: dict, label: np.ndarray, i: int, cols: np.ndarray) -> np.ndarray:
    """Those of ``cols`` outside the component of ``i`` that sizes and places let reach the similarity with it."""
    n, left = g["n"], g["n"] - g["pos"]
    near = (label[i] != label[cols]) & (5 * np.minimum(n[i], n[cols]) >= 4 * np.maximum(n[i], n[cols]))
    return cols[near & (9 * np.minimum(left[i], left[cols]) >= 4 * (n[i] + n[cols]))]


def _columns(group) -> dict:
    g = {k: group[k].to_numpy() for k in ("rep", "n", "pos", "component", "is_row", "is_col")}
    return g | {k: g[k].astype(np.int64) for k in ("n", "pos")}


def _possible(group):
    """The rows of a block that some row of another component may reach by their histograms.

    Two sets share at most the sum of their bins' lesser counts. Documents with only a passage in common share about half
    of their bins, so few of them are left to be compared by their sets.
    """
    g = _columns(group)
    bins = group["bins"].to_list()
    width = np.fromiter(map(len, bins), dtype=np.int64, count=len(bins))
    place, tables = np.zeros(len(bins), dtype=np.int64), {}
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        place[own] = np.arange(len(own))
        full = np.frombuffer(b"".join(bins[x] for x in own.tolist()), dtype=np.uint8).reshape(-1, w)
        tables[w, w] = full
        if w // 2 in width:  # sizes within 4 : 5 differ by one power of two at most
            tables[w, w // 2] = full[:, : w // 2].astype(np.uint16) + full[:, w // 2 :]
    stay = np.zeros(len(bins), dtype=bool)
    cols = np.flatnonzero(g["is_col"])
    for i in np.flatnonzero(g["is_row"]).tolist():
        some = _partners(g, g["component"], i, cols)
        hit = some if not width[i] else some[width[some] == 0]
        for w in (width[i] // 2, width[i], width[i] * 2) if width[i] else ():
            j = some[width[some] == w]
            if len(j):
                at = min(int(w), int(width[i]))
                both = np.minimum(tables[int(w), at][place[j]], tables[int(width[i]), at][place[i]]).sum(axis=1, dtype=np.int64)
                hit = np.concatenate([hit, j[9 * both >= 4 * (g["n"][i] + g["n"][j])]])
        stay[hit] = True
        stay[i] |= len(hit) > 0
    return group.loc[stay, [c for c in group.columns if c != "bins"]]


def _across(group):
    """A spanning forest of what a block's pairs of a similarity of 0.8 or more join beyond the components known so far."""
    import pandas as pd

    g = _columns(group)
    sets, n = group["h"].to_list(), g["n"]
    forest, cols = Forest(len(n)), np.flatnonzero(g["is_col"])
    forest.label = np.unique(g["component"], return_inverse=True)[1].ravel()
    for i in np.flatnonzero(g["is_row"]).tolist():
        some = _partners(g, forest.label, i, cols)
        for at in range(0, len(some), 256):
            j = some[at : at + 256]
            j = j[n[j] > 0] if n[i] else j[:0]
            if len(j):
                other = np.concatenate([sets[x] for x in j.tolist()])
                place = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][place] == other).astype(np.int64), np.cumsum(n[j]) - n[j])
                if len(hit := j[9 * both >= 4 * (n[i] + n[j])]):
                    forest.link(i, hit)
    return pd.DataFrame({"a": [g["rep"][i] for i, _ in forest.edges], "b": [g["rep"][j] for _, j in forest.edges]}, dtype="int64")


def _telling(large: DataFrame) -> DataFrame:
    """The buckets of ``large`` that bring pairs together which no bucket earlier in the order does.

    If all documents of a bucket have the same bucket before it, as those of a passage's shingles have, their pairs meet
    there already. A document's own buckets are few, so they are put in order per document.
    """
    before = F.lag("key").over(Window.partitionBy("rep").orderBy("pos"))
    own = large.withColumn("before", before)
    same = own.groupBy("key").agg(F.min("before").alias("x"), F.max("before").alias("y"), F.count_if(F.col("before").isNull()).alias("none"))
    return large.join(same.where("none > 0 or x <> y").select("key"), "key", "left_semi")


def _counted(small: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that share a bucket of ``small(key, rep, n, pos, big)`` and may reach the similarity.

    What two sets share is at most the prefix keys counted here, those in large buckets (``big`` of a set) and what lies
    behind the last shared place of both. Sets that have only a passage in common share too few of their prefix keys.
    """
    one, two = (small.select("key", *(F.col(c).alias(c[0] + x) for c in ("rep", "n", "pos", "big"))).withColumnRenamed("r" + x, x) for x in "ab")
    met = one.join(two, "key").where("a < b").where(_LONG_ENOUGH).groupBy("a", "b").agg(
        F.count("*").alias("m"), *(F.max(c + x).alias(c + x) for c in "npb" for x in "ab"))
    return met.where("9 * (m + least(ba, bb) + least(na - pa - 1, nb - pb - 1)) >= 4 * (na + nb)").select("a", "b")


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends ``edges(a, b)`` (one per b) don't join directly or through one ``a``."""
    for x in "ab":
        pairs = pairs.join(edges.select(F.col("b").alias(x), F.col("a").alias("c" + x)), x, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def linked(docs: DataFrame) -> DataFrame:
    """Rows ``rep, component``, one per different shingle set of ``docs(doc_id, text, ...)``; rep is the smallest doc_id
    that has the set, component the smallest reachable over pairs whose similarity is 0.8 or more.

    Null and empty texts have the empty set; rows without a doc_id are left out. Two sets of that similarity share a
    shingle among the first fifth of both in any one order, so buckets of these shingles meet all pairs; the order puts
    frequent shingles last to keep buckets small. Small buckets give all pairs that their counts allow. Large ones give
    pairs with few hubs; documents of those whose components still differ are then compared in blocks that return a
    spanning forest, so no bucket gives all its pairs; only sets that histograms leave in question go there. Every document's pair with
    its smallest partner is verified first, other pairs only where that has not joined their ends already.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, rows_path = _rows(docs)
    classes = cut(rows.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "fp")).alias("c")).select("sig", "n", F.col("c.doc_id").alias("rep"), F.col("c.fp").alias("fp")))
    by_print = cut(classes.groupBy("fp").agg(F.min("rep").alias("rep")))
    equal = classes.join(by_print.withColumnRenamed("rep", "a"), "fp").select("a", F.col("rep").alias("b"))
    own = bounded(classes.select(F.col("rep").alias("doc_id"), "sig"))
    keys = rows.join(own, ["doc_id", "sig"], "left_semi").select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "key"))
    shared, path = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    remove(docs.sparkSession, rows_path)
    large = shared.where(F.col("size") > SMALL)
    wide = cut(_telling(large))
    small = shared.where(F.col("size") <= SMALL).join(bounded(large.groupBy("rep").agg(F.count("*").alias("big"))), "rep", "left")
    by = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("by"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))).alias(f"h{k}") for k in range(HUBS)]
    hubs = wide.groupBy("key").agg(*by).select("key", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("h")).select("key", "h.a", "h.na", "h.pa")
    first = wide.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")).join(hubs, "key").where(_LONG_ENOUGH).where(_MAY_REACH).select("a", "b")
    pairs = links(by_print).unionByName(equal).unionByName(_counted(small.fillna(0, "big"))).unionByName(first).where("a <> b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = lambda found: found.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets, sets_path = _sets(docs, ends(pairs))
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = _verified(least, sets)
    more = cut(_apart(pairs.join(least, ["a", "b"], "left_anti"), edges))
    edges = cut(edges.unionByName(_verified(more, sets.join(bounded(ends(more)), "rep", "left_semi"))))
    remove(docs.sparkSession, sets_path)
    found = cut(components(edges))
    placed = wide.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "pos", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("resident"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    blocks = block_pairs(placed.join(open_keys, "key", "left_semi"), ["key"], "rep", BLOCK_ROWS, BLOCK_COLS)
    blocks = cut(blocks)
    if not blocks.isEmpty():
        by = ["key", "block_r", "block_c"]
        blocks = cut(blocks.join(_histograms(docs, blocks), "rep").groupBy(*by).applyInPandas(_possible, blocks.schema))
        sets, sets_path = _sets(docs, blocks)
        more = cut(blocks.join(sets, "rep").groupBy(*by).applyInPandas(_across, "a long, b long"))
        remove(docs.sparkSession, sets_path)
        found = cut(components(edges.unionByName(more)))
    remove(docs.sparkSession, path)
    return classes.join(found, classes.rep == found.node, "left").select("rep", F.coalesce("component", "rep").alias("component"))
