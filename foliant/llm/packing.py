"""Best-fit packing by patterns: non-negative least squares over few-document length patterns."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, cut, slices, table

LENGTH = 2048
#: Patterns tried and rounds of the least-squares fit; both bound the driver's work, whatever the corpus.
PATTERNS, ROUNDS, SEED = 40_000, 200, 5
#: Pieces that one task ranks, about.
RANKED = 200_000
#: Words whose ids a Python worker remembers (about 120 bytes each).
REMEMBERED = 400_000

_words: dict[bytes, bytes] = {}
_tokenizer: list = []
#: A stop or comma that ends a word of letters: the tokenizer parts it from the word, so looking both up apart is the same.
_STOP = re.compile(rb"([,.])(?<=[a-z].)(?=\s)")


def forget() -> None:
    """Drop the tokenizer and the words that this Python worker remembers."""
    _words.clear()
    _tokenizer.clear()


def word_ids(path: str):
    """The tokenizer at ``path`` and which of its ids end a word, loaded once per Python worker."""
    claim("packing", forget)
    if not _tokenizer or _tokenizer[0] != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _tokenizer[:] = [path, tokenizer, ends]
        _words.clear()
    return _tokenizer[1], _tokenizer[2]


def split_words(text: bytes) -> list[bytes]:
    """Pieces of ``text`` whose ids one after the other are the text's: the tokenizer lowers letters and drops white
    space. A text that may hold one of the tokenizer's special strings is left as it is."""
    if b"<|" in text:
        return text.split()
    return _STOP.sub(rb" \1", text.lower()).split()


def remember(words: set[bytes], path: str) -> None:
    """Tokenize ``words`` into the memory. Words of letters alone go in lines: each has one id that ends a word, its last."""
    tokenizer, ends = word_ids(path)
    plain, odd = [], []
    for w in words:
        (plain if w.decode().isalpha() else odd).append(w)
    for at in range(0, len(plain), 1000):
        some = plain[at : at + 1000]
        ids = np.array(tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(some):
            odd += some
            continue
        raw = ids.tobytes()
        edges = [0, *(4 * stop).tolist()]
        _words.update(zip(some, [raw[a:b] for a, b in zip(edges, edges[1:])]))
    for at in range(0, len(odd), 20_000):
        some = odd[at : at + 20_000]
        for w, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
            _words[w] = np.array(e.ids, dtype="<u4").tobytes()


def ids_of(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit bytes, without the end id.

    The tokenizer never joins across white space, so ids are looked up word by word and only unseen words are
    tokenized. The memory is cleared when it is full.
    """
    word_ids(path)
    split = [split_words(t) for t in texts]
    new = set().union(*split).difference(_words)
    if new and len(_words) + len(new) > REMEMBERED:
        _words.clear()
        new = set().union(*split)
    remember(new, path)
    look = _words.__getitem__
    return [b"".join(map(look, words)) for words in split]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32``: each document's ids and an end id, cut at ``length``.

    Null text counts as empty and gives one piece with the end id alone.
    """
    name = path or tokenizer_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "text"):
                doc, piece, start, size, crc = [], [], [], [], []
                texts = [(x or "").encode("utf-8", "replace") for x in b.column("text").to_pylist()]
                for d, ids in zip(b.column("doc_id").to_pylist(), ids_of(texts, name)):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, length)):
                        doc.append(d)
                        piece.append(k)
                        start.append(at)
                        size.append(min(length, n - at))
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns_of(histogram: np.ndarray, length: int, rng: np.random.Generator, tries: int = PATTERNS) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to ``length`` or as near below it as lengths allow."""
    present = np.flatnonzero(histogram)
    present = present[(present > 0) & (present <= length)]
    if not len(present):
        return np.zeros((0, 4), dtype=np.int64)
    below = np.zeros(length + 1, dtype=np.int64)  # the largest length present that is at most so long
    below[present] = present
    below = np.maximum.accumulate(below)
    weight = histogram[present] / histogram[present].sum()
    found = [np.stack([present, below[length - present], np.zeros_like(present), np.zeros_like(present)], axis=1)]
    a = np.concatenate([rng.choice(present, tries, p=weight), rng.choice(present, tries // 2)])
    b = rng.choice(present, len(a), p=weight)
    b = np.where(a + b <= length, b, 0)
    found.append(np.stack([a, b, below[length - a - b], np.zeros_like(a)], axis=1))
    c = rng.choice(present, len(a), p=weight)
    c = np.where(a + b + c <= length, c, 0)
    found.append(np.stack([a, b, c, below[length - a - b - c]], axis=1))
    return np.unique(-np.sort(-np.concatenate(found), axis=1), axis=0)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeat counts x that bring ||A x - histogram|| down, A counting lengths in patterns.

    Multiplicative updates: all numbers are non-negative, so the sign holds by itself.
    """
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]), minlength=size) * (np.arange(size) > 0)

    goal = histogram * (np.arange(size) > 0.0)
    up = goal[patterns].sum(axis=1)
    full = patterns.sum(axis=1) / max(1, patterns.sum(axis=1).max(initial=1))
    x = full**32 * histogram.sum() / max(1, len(patterns))  # full patterns start ahead
    for _ in range(rounds):
        x *= up / np.maximum(used(x)[patterns].sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Pairs (lengths of a sequence, how many such sequences) that use up ``histogram`` exactly.

    The fitted counts are rounded down and cut where lengths run out; what is left is packed best-fit
    decreasing, run by run over the histogram. Both lists are bounded by the number of patterns and lengths.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []
    rng = np.random.default_rng(SEED)
    patterns = patterns_of(left, length, rng)
    if len(patterns):
        x = fit(patterns, left.astype(float))
        order = np.lexsort((-x, -patterns.sum(axis=1)))
        for k in order.tolist():
            times = int(x[k] + 0.5)
            if times < 1:
                continue
            own, many = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            times = min(times, int((left[own] // many).min()))
            if times:
                left[own] -= many * times
                out.append((patterns[k][patterns[k] > 0].tolist(), times))
    while left.any():
        take, room = np.zeros_like(left), length
        own: list[int] = []
        while True:
            fits = np.flatnonzero(left[: room + 1] > take[: room + 1])
            if not len(fits):
                break
            own.append(int(fits[-1]))
            take[fits[-1]] += 1
            room -= int(fits[-1])
        used = np.flatnonzero(take)
        times = int((left[used] // take[used]).min())
        left[used] -= take[used] * times
        out.append((own, times))
    return out


def slots(runs: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in rank order: where its pieces go."""
    found: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for own, times in runs:
        at = 0
        for size in own:
            found.setdefault(size, []).append((rank.get(size, 0), sequence, at))
            rank[size] = rank.get(size, 0) + times
            at += size
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut_pieces`` (with a column ``length``, 1 to ``length``) plus ``sequence_id`` and ``offset``.

    Only the histogram of lengths (2048 numbers) comes to the driver. Pieces of one length are interchangeable:
    each gets a rank within its length, from its rank within (length, bucket) and the counts of the buckets before
    it, and the rank names its place. The buckets are of bounded size, so a length that a third of all pieces share
    is ranked by many tasks.
    """
    spark = cut_pieces.sparkSession
    histogram = np.zeros(length + 1, dtype=np.int64)
    for r in cut_pieces.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    places = spark.sparkContext.broadcast(slots(plan(histogram, length)))
    buckets = int(histogram.sum() // RANKED + 16)
    dealt = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("_own", own).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    names = [f.name for f in ranked.schema if f.name != "_rank"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table_ = places.value
        for b in batches:
            size = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                rows = table_[s][np.searchsorted(table_[s][:, 0], rank[at], side="right") - 1]
                sequence[at] = rows[:, 1] + rank[at] - rows[:, 0]
                offset[at] = rows[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one per piece of every row of ``docs``.

    Null and empty texts are one piece, the end id. Repeated rows are packed each on their own. A row without a
    doc_id is packed with a null id. An empty table gives no rows. Other columns are ignored.
    """
    return pack(cut(pieces(docs, path, length)), length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
