"""Exact substring deduplication by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, remove, slices, table, written

WINDOW = 50
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers modulo 2^64 of ``base`` and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        inverse, size = pow(base, -1, 2**64), max(1024, 1 << int(n - 1).bit_length() if n > 1 else 1)
        have = tuple(np.multiply.accumulate(np.array([1] + [b] * (size - 1), dtype=np.uint64)) for b in (base, inverse))
        if size <= 1 << 20:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split cuts at the ASCII white space and nothing else."""
    return (text or "").encode("utf-8", "replace").split()


def hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def windows(words: np.ndarray, length: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each window of ``length`` words, from the words' hashes; equal windows have equal hashes anywhere."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(base, len(words))
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up, dtype=np.uint64)])
    return _mixed((total[length:] - total[:n]) * down[:n])


def sliding(values: np.ndarray, span: int, least: bool = True) -> np.ndarray:
    """The least (or greatest) value of each run of ``span`` values, by doubling."""
    pick = np.minimum if least else np.maximum
    out, width = values, 1
    while 2 * width <= span:
        out = pick(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: each twice the one before, as long as a repeated window of ``window`` words that holds
    a shorter one has room on one side of it for the doubled one."""
    out = [max(1, window // 8)]
    while 2 * out[-1] <= window and 3 * out[-1] - 1 <= window:
        out.append(2 * out[-1])
    return out


def anchors(short: np.ndarray, span: int) -> np.ndarray:
    """Positions of the short windows that are the least of some full window: what a repeat of a window repeats too.

    A full window holds ``span`` short ones. Which of them is least depends on its own words alone, so all copies of a
    full window share it, and one in about span / 2 positions is enough.
    """
    if len(short) < span:
        return np.zeros(0, dtype=np.int64)
    low = sliding(short, span)
    pad = np.zeros(span - 1, dtype=np.uint64)
    reach = sliding(np.concatenate([pad, low, pad]), span, least=False)
    return np.flatnonzero(reach == short)


def sequence_hash(words: np.ndarray) -> int:
    return int(windows(words, len(words), BASES[1])[0].view(np.int64)) if len(words) else 0


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _marks(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, seq, seq2, whole`` (digest of all words) and the hashes of each document's anchors."""
    start = lengths(window)[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                n, seq, seq2, whole, hs = [], [], [], [], []
                for t in b.column("text"):
                    words = words_of(t.as_py())
                    w = hashed(words)
                    n.append(len(w))
                    seq.append(sequence_hash(w))
                    seq2.append(int(windows(w, len(w))[0].view(np.int64)) if len(w) else 0)
                    whole.append(digest(words))
                    h = windows(w, start) if len(w) >= window else np.zeros(0, dtype=np.uint64)
                    hs.append(np.unique(h[anchors(h, window - start + 1)]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(seq2, pa.int64()), pa.array(whole, pa.string()), pa.array(hs, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "seq", "seq2", "whole", "anchors"])

    return docs.mapInArrow(run, "doc_id long, n_words long, seq long, seq2 long, whole string, anchors array<long>")


def _with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found(doc_id, seq, own)`` names, with its rows by doc_id in ``found``.

    Only these texts are shuffled. ``own`` is a list of longs; which entry is a row's own is told by its sequence hash.
    """
    found = cut(found.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "own")).alias("found")))
    return docs.join(bounded(found.select("doc_id")), "doc_id", "left_semi").join(found, "doc_id")


def _own(texts: DataFrame, work, schema: str) -> DataFrame:
    """``work(words, hashes, own)`` gives the columns after doc_id and seq of each row of ``_with_texts``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (c.split() for c in schema.split(", "))])
        for batch in batches:
            for b in slices(batch, "text"):
                rows = []
                for doc, t, found in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("found").to_pylist()):
                    words = words_of(t)
                    w = hashed(words)
                    seq = sequence_hash(w)
                    own = next((f["own"] for f in found if f["seq"] == seq), None)
                    if own is not None:
                        rows.append((doc, seq, *work(words, w, np.array(own, dtype=np.int64))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), types)], schema=types)

    return texts.select("doc_id", "text", "found").mapInArrow(run, schema)


def _extended(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """For each document the windows of every level that repeated anchors can grow into: ``level, place, key`` as arrays.

    A window of a level starts where one of the level before starts, or ends where that ends.
    """
    levels = lengths(window)

    def work(words: list[bytes], w: np.ndarray, own: np.ndarray) -> tuple:
        short = windows(w, levels[0])
        at = anchors(short, window - levels[0] + 1)
        at = at[np.isin(short[at], own.view(np.uint64))]
        level, place, key = [np.zeros(len(at), dtype=np.int32)], [at.astype(np.int32)], [short[at].view(np.int64)]
        for k, size in enumerate(levels[1:], 1):
            at = np.unique(np.concatenate([at, at - levels[k - 1]]))
            at = at[(at >= 0) & (at + size <= len(w))]
            level.append(np.full(len(at), k, dtype=np.int32))
            place.append(at.astype(np.int32))
            key.append(windows(w, size)[at].view(np.int64))
        return tuple(map(np.concatenate, (level, place, key)))

    rows = _own(_with_texts(docs, hits), work, "doc_id long, seq long, level array<int>, place array<int>, key array<long>")
    return rows.select("doc_id", "seq", F.explode(F.arrays_zip("level", "place", "key")).alias("w")).select("doc_id", "seq", "w.*")


def _repeated(each: DataFrame) -> DataFrame:
    """The rows of ``each(doc_id, key, ...)`` whose key occurs in documents of different ids."""
    keys = each.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    return each.join(bounded(keys), "key", "left_semi")


def _full(docs: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """The windows of full length around surviving ones: rows ``doc_id, seq, places, key, key2``."""
    last = lengths(window)[-1]

    def work(words: list[bytes], w: np.ndarray, own: np.ndarray) -> tuple:
        edge = np.zeros(len(w) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(own + last - window, 0), 1)
        np.add.at(edge, own + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[: len(w) - window + 1] > 0)
        return (at.astype(np.int32), *(windows(w, window, x)[at].view(np.int64) for x in BASES))

    rows = _own(_with_texts(docs, spots), work, "doc_id long, seq long, places array<int>, key array<long>, key2 array<long>")
    return rows.select("doc_id", "seq", F.explode(F.arrays_zip("places", "key", "key2")).alias("w")).select("doc_id", "seq", "w.*")


def _remove(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    def work(words: list[bytes], w: np.ndarray, own: np.ndarray) -> tuple:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        places = np.unique(own)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + window, -1)
        cover = np.cumsum(edge)[:-1] > 0
        return len(words), int(cover.sum()), digest([x for x, c in zip(words, cover.tolist()) if not c])

    return _own(_with_texts(docs, hits), work, "doc_id long, seq long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept_sha256``, one per row of ``docs(doc_id, text, ...)``.

    A word goes if a window of ``window`` words covers it whose words also start in a document with a smaller
    doc_id. Levels double: of the windows of 6 words (for 50) the least one in each full window is looked up (see
    ``anchors``); those that occur in two documents are extended, to both sides, to windows of 12 words, repeated ones of
    these to 24, and only windows of the full length around ones repeated at 24 are compared, which is the exact last
    step. A level without a survivor ends the search. A repeated full window is never lost: all its copies share its
    anchor, and a doubled window inside it at each level. A longer repeat is a union of full windows.

    A document whose words are all those of a document with a smaller id is found by its sequence hash and takes no part
    in the levels. Full windows are compared by two 64-bit hashes, shorter ones by one (they only propose).

    Null and empty texts have no words. Rows of one doc_id never remove each other's words. A row without a doc_id
    has none smaller, so it is returned whole. Repeated rows get a result each; an empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = lengths(window)
    marks = cut(_marks(docs, window))
    able = marks.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    copied = able.groupBy("seq", "seq2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copied = bounded(copied.select("seq", "seq2", "first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    each = able.join(copied, ["seq", "seq2"], "left").where(~copy).select("doc_id", "seq", F.explode("anchors").alias("key"))
    hits = _repeated(each).groupBy("doc_id", "seq").agg(F.collect_list("key").alias("own"))
    grown, grown_at = written(_extended(docs, hits, window))
    alive = grown.where("level = 0").select("doc_id", "seq", "place")
    for k in range(1, len(levels)):
        reach = alive.select("doc_id", "seq", F.explode(F.array(F.col("place"), F.col("place") - levels[k - 1])).alias("place")).distinct()
        alive = cut(_repeated(grown.where(F.col("level") == k).join(reach, ["doc_id", "seq", "place"], "left_semi")).select("doc_id", "seq", "place"))
        if alive.isEmpty():
            break
    spots = alive.groupBy("doc_id", "seq").agg(F.collect_list(F.col("place").cast("long")).alias("own"))
    each, each_at = written(_full(docs, spots, window))
    first = each.groupBy("key", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    hit = each.join(cut(first), ["key", "key2"]).where("doc_id > first").groupBy("doc_id", "seq").agg(F.collect_list(F.col("places").cast("long")).alias("own"))
    removed = cut(_remove(docs, hit, window))
    for path in (grown_at, each_at):
        remove(docs.sparkSession, path)
    done = bounded(removed.select("doc_id", "seq").distinct())
    rest = marks.join(done, ["doc_id", "seq"], "left_anti").join(copied, ["seq", "seq2"], "left").withColumn("copy", copy & (F.col("n_words") >= window))
    rest = rest.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), F.lit(digest([]))).otherwise(F.col("whole")).alias("kept_sha256"))
    return rest.unionByName(removed.drop("seq"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
