"""Exact top-k inner-product search, block at a time with bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K, EVERY = 5, 50
#: Rows of a document-range block, blocks that one task holds, queries that one task holds.
BLOCK, BLOCKS_A_GROUP, QUERIES_A_BLOCK = 1024, 64, 8192
#: The score of no candidate; its negative is a number too.
NONE = -(1 << 62)


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def quantised(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, q`` with q = floor(256 x) of every component; rows that take no part are left out."""
    return vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"))


def _matrix(column) -> np.ndarray:
    return np.concatenate([x.values.to_numpy(zero_copy_only=False)[None, :] for x in column]) if len(column) else np.zeros((0, 0))


def blocks_of(quant: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Forward indexes: rows ``dims, ids, q, high, low`` of up to ``rows`` vectors each, as little-endian bytes.

    A block is a range of the rows of one partition, so no shuffle is needed. ``high`` and ``low`` hold each
    term's (component's) largest and smallest value in the block.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dims: int, part: list) -> pa.RecordBatch:
            ids, q = np.array([x[0] for x in part], dtype="<i8"), np.array([x[1] for x in part], dtype="<i8").reshape(len(part), dims)
            order = np.argsort(ids, kind="stable")
            ids, q = ids[order], q[order]
            columns = [ids.tobytes(), q.tobytes(), q.max(axis=0).tobytes(), q.min(axis=0).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["dims", "ids", "q", "high", "low"])

        for b in batches:
            for i, q in zip(b.column("vec_id").to_pylist(), b.column("q").to_pylist()):
                part = held.setdefault(len(q), [])
                part.append((i, q))
                if len(part) == rows:
                    yield block(len(q), part)
                    held[len(q)] = []
        for dims, part in held.items():
            if part:
                yield block(dims, part)

    return quant.mapInArrow(run, "dims int, ids binary, q binary, high binary, low binary")


def search_block(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, vec_id) of each query over ``blocks`` (ids, q, high, low), its own id left out.

    Blocks are taken in the order of the sum over terms of the best product that the block's extremes allow, per
    query. A query is done when that bound falls below its kth score; equal bounds are still scored, for ties.
    """
    n = len(queries)
    low = NONE
    scores = np.full((n, k), low)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.stack([up @ high + down @ small for _, _, high, small in blocks], axis=1)
    order = np.argsort(-bound, axis=1, kind="stable")
    for turn in range(len(blocks)):
        pick = order[:, turn]
        open_ = bound[np.arange(n), pick] >= scores[:, -1]
        if not open_.any():
            break
        for b in np.unique(pick[open_]).tolist():
            who = np.flatnonzero(open_ & (pick == b))
            own_ids, q, _, _ = blocks[b]
            got = _products(queries[who], q)
            got[own_ids[None, :] == query_ids[who][:, None]] = low
            all_s = np.concatenate([scores[who], got], axis=1)
            all_i = np.concatenate([ids[who], np.broadcast_to(own_ids, got.shape)], axis=1)
            if all_s.shape[1] > 4 * k:
                # every score at or above the kth stays, so that ties are cut by id and not by place
                kth = np.partition(all_s, -k, axis=1)[:, -k]
                for r, row in enumerate(who.tolist()):
                    at = np.flatnonzero(all_s[r] >= kth[r])
                    best = at[np.lexsort((all_i[r][at], -all_s[r][at]))[:k]]
                    scores[row], ids[row] = all_s[r][best], all_i[r][best]
            else:
                best = np.stack([np.lexsort((i, -s))[:k] for s, i in zip(all_s, all_i)])
                scores[who], ids[who] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
    return scores, ids


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where every partial sum is exact in them."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**52:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: for each of ``queries`` the k best of ``vectors``.

    Both have ``vec_id, embedding``. Vectors that are null, empty or hold null or non-finite components take no part;
    nor do rows without a vec_id. A query meets only vectors of its own length, and never its own vec_id. Equal scores go
    to the smaller vec_id; repeated rows count each. Queries without a candidate give no rows.

    Documents become blocks (forward index and term extremes), blocks are dealt into groups of bounded size, queries
    into blocks of bounded size. A task takes one group and one query block, prunes within it, and returns k rows a
    query; these are ranked at the end. Nothing whole passes through one task.
    """
    blocks = cut(blocks_of(quantised(vectors)))
    asked = quantised(queries).select("vec_id", "q", F.size("q").alias("dims"))
    asked = asked.withColumn("query_block", F.monotonically_increasing_id())
    groups = max(1, -(-blocks.count() // BLOCKS_A_GROUP))
    asked = cut(asked)
    query_blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query_block"), F.lit(query_blocks)).cast("int"))
    left = blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(docs, some):
        import pandas as pd

        out = []
        for dims, own in some.groupby("dims"):
            here = docs[docs["dims"] == dims]
            if not len(here):
                continue
            load = lambda x, *s: np.frombuffer(x, dtype="<i8").reshape(*s) if s else np.frombuffer(x, dtype="<i8")
            parts = [(load(r.ids), load(r.q, -1, dims), load(r.high), load(r.low)) for r in here.itertuples()]
            q, ids = np.stack(own["q"].to_list()), own["vec_id"].to_numpy()
            for at in range(0, len(q), 512):
                s, i = search_block(q[at : at + 512], ids[at : at + 512], parts, k)
                out.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + 512], k), "vec_id": i.ravel(), "score": s.ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return found[found["score"] > NONE]

    found = left.groupBy("group", "query_block").cogroup(right.groupBy("group", "query_block")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0))


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
