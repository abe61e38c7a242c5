"""Graphs from reference lists: coupling, co-citation, sparse edges, lineage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bounded, stored


#: Neighbours from which on a node's pairs are dealt to HUB_PARTS tasks, and occurrences of pairs that a task counts. They steer cost alone.
HUB, HUB_PARTS, COUNTED = 100_000, 16, 1_000_000
#: Edges that a task ranks at a time before the shuffle.
RANKED = 1_000_000
SHARED, CO, DIRECT = 0, 1, 2


def weights(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Bibliographic coupling and co-citation of each seed with others, from ``refs(citing, cited)`` (distinct rows).

    Coupling: shared references over the root of both counts. Co-citation: shared citers likewise, times n / (n + 2).
    Weight: 0.65 and 0.35 of these, 0.12 more for a direct citation, 1 at most. Only pairs with a seed are formed; a seed
    is compared with what shares a neighbour, never with all nodes.

    A node is sent each neighbour's list of seeds, and its pairs are counted where these lists arrive: pairs, of which there
    are far more than references, are made after the one shuffle by node. Counts come with the references and, for
    seeds, by a join of these few. The number of tasks follows the number of occurrences, which is known before they are made.
    """
    refs = stored(refs.select("citing", "cited"))
    ends = refs.select(F.col("citing").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inn")).unionByName(refs.select(F.col("cited").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inn")))
    counts = ends.groupBy("node").agg(F.struct(F.sum("out").alias("out"), F.sum("inn").alias("inn")).alias("n"))
    rows = stored(refs.join(counts.withColumnsRenamed({"node": "citing", "n": "citing_n"}), "citing").join(counts.withColumnsRenamed({"node": "cited", "n": "cited_n"}), "cited"))
    few = bounded(seeds)
    own = stored(rows.join(few, F.col("citing") == F.col("seed")))
    by = stored(rows.join(few, F.col("cited") == F.col("seed")))
    made = own.agg(F.sum("cited_n.inn").alias("n")).unionByName(by.agg(F.sum("citing_n.out").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def sent(df: DataFrame, node: str, met: Column, kind: int) -> DataFrame:
        n = F.col(f"{node}_n")
        dealt = F.transform(met, lambda s: F.struct((F.pmod(F.xxhash64(s), F.lit(HUB_PARTS)) + 1).alias("part"), F.array(s).alias("met")))
        parts = F.when(n["out"] + n["inn"] >= HUB, dealt).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("part"), met.alias("met"))))
        return df.select(F.col(node).alias("node"), n.alias("n"), F.lit(kind).alias("kind"), F.explode(parts).alias("p")).select("node", "n", "kind", "p.*")

    lists = lambda df, key: df.groupBy(key).agg(F.collect_list("seed").alias("met"))
    every = sent(rows.join(lists(own, "cited"), "cited"), "citing", F.col("met"), SHARED).unionByName(sent(rows.join(lists(by, "citing"), "citing"), "cited", F.col("met"), CO))
    every = every.unionByName(sent(own, "cited", F.array("seed"), DIRECT)).unionByName(sent(by, "citing", F.array("seed"), DIRECT))
    every = every.repartition(max(1, -(-int(made) // COUNTED)), "node", "part")
    occurrences = every.select("node", "part", "kind", F.col("n.out").alias("out"), F.col("n.inn").alias("inn"), F.explode("met").alias("seed")).where("seed <> node")
    pairs = occurrences.groupBy("node", "part", "seed").agg(
        F.count_if(F.col("kind") == SHARED).alias("shared"), F.count_if(F.col("kind") == CO).alias("co"), F.max((F.col("kind") == DIRECT).cast("int")).alias("direct"), F.max("out").alias("out"), F.max("inn").alias("inn"))
    of_seeds = own.select("seed", F.col("citing_n").alias("n")).unionByName(by.select("seed", F.col("cited_n").alias("n"))).select("seed", F.col("n.out").alias("s_out"), F.col("n.inn").alias("s_inn")).distinct()
    pairs = pairs.join(bounded(of_seeds), "seed")
    coupling = F.when(F.col("shared") > 0, F.col("shared") / F.sqrt(F.col("s_out") * F.col("out"))).otherwise(0.0)
    cocited = F.when(F.col("co") > 0, F.col("co") / F.sqrt(F.col("s_inn") * F.col("inn")) * F.col("co") / (F.col("co") + 2)).otherwise(0.0)
    weight = F.least(F.lit(1.0), 0.65 * coupling + 0.35 * cocited + 0.12 * F.col("direct"))
    return pairs.select("seed", "node", "shared", "co", "direct", F.round(weight, 9).alias("weight"))


def strongest(edges: DataFrame, n: int = 3) -> DataFrame:
    """Edges ``a, b, weight`` (none null) among the ``n`` strongest of either end.

    Tasks first leave out, block by block, what is not among the ``n`` strongest of an end within the block, so that few edges are shuffled and sorted.
    """
    schema = edges.select(F.col("a").alias("end"), F.col("b").alias("other"), "weight", F.lit(True).alias("first")).schema

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(held: list) -> pa.RecordBatch:
            a, b, w = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b", "weight"))
            end, other, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
            names, code = np.unique(end, return_inverse=True)
            order = np.lexsort((other, -w, code))
            start = np.searchsorted(code[order], np.arange(len(names)))
            at = order[np.arange(len(order)) - start[code[order]] < n]
            return pa.RecordBatch.from_arrays([pa.array(end[at]), pa.array(other[at]), pa.array(w[at]), pa.array(at < len(a))], names=schema.names)

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= RANKED:
                yield block(held)
                held = []
        if held:
            yield block(held)

    ends = edges.select("a", "b", "weight").mapInArrow(near, schema)
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("weight"), "other"))
    one, two = F.col("end"), F.col("other")
    return ends.withColumn("_n", rank).where(F.col("_n") <= n).select(F.when(F.col("first"), one).otherwise(two).alias("a"), F.when(F.col("first"), two).otherwise(one).alias("b"), "weight").distinct()


def prior_and_derivative(refs: DataFrame, selected: DataFrame, most: int = 60) -> DataFrame:
    """Works that the selected ones cite most (prior) and that cite most of them (derivative), not selected themselves."""
    prior = refs.join(selected.withColumnRenamed("node", "citing"), "citing", "left_semi").groupBy(F.col("cited").alias("node")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("prior"))
    after = refs.join(selected.withColumnRenamed("node", "cited"), "cited", "left_semi").groupBy(F.col("citing").alias("node")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("derivative"))
    both = prior.unionByName(after).join(selected, "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "node"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def lineage(refs: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Rows ``node, level``: nodes reached from ``seeds`` along citations (citing to cited) within ``hops``, at the least level."""
    seen = seeds.select("node", F.lit(0).alias("level"))
    edge = refs.select(F.col("citing").alias("node"), F.col("cited").alias("next")).distinct()
    front = seen
    for level in range(1, hops + 1):
        reached = front.join(edge, "node").select(F.col("next").alias("node")).distinct()
        front = reached.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen
