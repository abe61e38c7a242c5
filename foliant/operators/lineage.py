"""Prior and derivative works of roots along citations: levels, one path each, and a capped selection that keeps its paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import bounded, cut

PRIOR, DERIVATIVE = "prior", "derivative"
#: Parts that the edges of a node are dealt to, so that a hub is no single task.
SALTS = 16
#: Roots whose selection a task makes.
CHOSEN = 500


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is in ``keys``, a frame of one column of that type: without a shuffle of ``rows`` if the keys are few."""
    keys = bounded(keys.toDF(column).distinct())
    return rows.join(keys, column, "left_semi")


def reached(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3, directions: tuple[str, ...] = (PRIOR, DERIVATIVE)) -> DataFrame:
    """Rows ``root, tree, node, level, path``: nodes of ``nodes(node)`` within ``depth`` citations of each of ``roots(root)``.

    ``edges(source, target)`` go from the cited to the citing work; the prior tree follows them backwards. A level reads the edges once and
    keeps those of its frontier's nodes; these are joined with it, dealt to SALTS parts, and only what they reach is looked up in ``nodes``.
    So edges and nodes, which are read at every level, had better be stored. ``path`` holds the nodes below the root up to this one, and of several ways of
    one length the least path is kept, which is what a breadth-first walk that visits neighbours in order finds. Cycles, loops, repeated edges and edges
    to unknown nodes add nothing. Each level is an aggregate with map-side combine and an
    anti-join with the levels before, and is written, so that plans stay short and a lost executor costs a level. A tree ends where a level is empty.
    """
    real = edges.select("source", "target").where("source <> target")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    ways = {PRIOR: real.select(F.col("target").alias("at"), F.col("source").alias("next"), part("source")), DERIVATIVE: real.select(F.col("source").alias("at"), F.col("target").alias("next"), part("target"))}
    start = cut(among(nodes.select(F.col("node").alias("root")), "root", roots.select("root")).distinct())
    kind = nodes.schema["node"].dataType.simpleString()
    trees = []
    for tree in directions:
        seen = start.select("root", F.col("root").alias("node"), F.lit(0).alias("level"), F.array().cast(f"array<{kind}>").alias("path"))
        front = seen
        for level in range(1, depth + 1):
            own = among(ways[tree], "at", front.select("node"))
            dealt = front.select("root", F.col("node").alias("at"), "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            new = cut(dealt.join(own, ["at", "salt"]).groupBy("root", F.col("next").alias("node")).agg(F.min("path").alias("path")))
            new = new.join(among(nodes.select("node"), "node", new.select("node")).distinct(), "node", "left_semi")
            front = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), F.concat("path", F.array("node")).alias("path")))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        trees.append(seen.withColumn("tree", F.lit(tree)))
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.select("root", "tree", "node", "level", "path")


def _chosen(limit: int, depth: int, schema: pa.Schema):
    def run(rows: pa.Table) -> pa.Table:
        """Queues of a root in turns by level and tree; a candidate comes with the missing part of its path, or not at all."""
        root, tree, level, node, nearest, cited, needs = (rows.column(c).to_pylist() for c in ("root", "tree", "level", "node", "nearest", "cited", "needs"))
        queues: dict[tuple, list] = {(at, t): [] for at in range(1, depth + 1) for t in (PRIOR, DERIVATIVE)}
        for i in sorted(range(len(node)), key=lambda i: (nearest[i], -cited[i], node[i])):
            queues[level[i], tree[i]].append((node[i], needs[i]))
        places, kept = [0] * len(queues), {root[0]: None}
        moved = True
        while len(kept) < limit and moved:
            moved = False
            for q, queue in enumerate(queues.values()):
                while places[q] < len(queue) and len(kept) < limit:
                    own, before = queue[places[q]]
                    places[q] += 1
                    path = [n for n in (*before, own) if n not in kept]
                    if own not in kept and len(kept) + len(path) <= limit:
                        kept.update(dict.fromkeys(path))
                        moved = True
                        break
        return pa.Table.from_pydict({"root": [root[0]] * len(kept), "node": list(kept)}, schema)

    return run


def explored(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 3, limit: int = 30, directions: tuple[str, ...] = (PRIOR, DERIVATIVE), wanted: Column | None = None) -> DataFrame:
    """Rows ``root, node, lineage_level, prior_level, derivative_level`` of at most ``limit`` nodes a root, the root among them.

    ``nodes(node, cited)`` give the citation counts. Levels and trees take turns, so a large first level does not use up the cap; within
    one, nodes of the least level in any tree come first, then by citations, then by id. A chosen node brings the nodes of its path; if
    these don't fit it is passed over. Nodes for which ``wanted`` is not true are neither chosen nor on paths, but are walked through.

    A root's task gets a bounded part of its lineage, which holds all that the turns can take: while three places are free a queue's next new node
    is always taken, so no more than twice ``limit`` of each queue are looked at; later a node must have all but one or none of the nodes it needs
    among those taken, so as many of each such set of needs are enough. Null counts are 0.
    """
    if not 1 <= depth <= 3:
        raise ValueError("the bounds hold for one to three levels")
    keep = 2 * limit
    all_rows = reached(edges, nodes, roots, depth, directions)
    usable = nodes.withColumn("_wanted", F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).select("node", F.coalesce(F.col("cited"), F.lit(0)).alias("cited"), "_wanted")
    usable = cut(among(usable, "node", all_rows.select("node")))
    levels = all_rows.groupBy("root", "node").agg(*(F.min(F.when((F.col("tree") == t) | (F.col("level") == 0), F.col("level"))).alias(f"{t}_level") for t in (PRIOR, DERIVATIVE)), F.min("level").alias("nearest"))
    ok = usable.where("_wanted").select("node")
    steps = all_rows.where("level > 0").select("root", "tree", F.col("node").alias("end"), "level", F.posexplode("path").alias("at", "node")).where("at < level - 1")
    needs = steps.join(ok, "node", "left_semi").groupBy("root", "tree", F.col("end").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda s: s["node"]).alias("needs"))
    kind = nodes.schema["node"].dataType.simpleString()
    rows = all_rows.where("level > 0").join(usable.where("_wanted").select("node", "cited"), "node").join(levels.select("root", "node", "nearest"), ["root", "node"]).join(needs, ["root", "tree", "node"], "left")
    rows = rows.withColumn("needs", F.coalesce("needs", F.array().cast(f"array<{kind}>"))).drop("path")
    rows = cut(rows)
    queue = ["root", "tree", "level"]
    order = [F.col("nearest"), F.desc("cited"), F.col("node")]

    def first(df: DataFrame, *keys: Column | str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*queue, *keys).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")

    def nodes_of(df: DataFrame) -> DataFrame:
        return df.select("root", F.explode(F.concat("needs", F.array("node"))).alias("have")).unionByName(df.select("root", F.col("root").alias("have"))).distinct()

    def reachable(df: DataFrame, have: DataFrame, missing: int) -> DataFrame:
        """Rows of which all but ``missing`` needed nodes are in ``have``."""
        asked = df.select(*queue, "node", F.explode("needs").alias("have")).join(have, ["root", "have"], "left_semi").groupBy(*queue, "node").agg(F.count("*").alias("_has"))
        return df.join(asked, [*queue, "node"]).where(F.size("needs") - F.col("_has") <= missing).drop("_has")

    early = cut(first(rows).unionByName(first(rows, F.size("needs"))).distinct())
    have = nodes_of(early)
    by_all = cut(first(rows.where(F.size("needs") > 0), "needs"))
    by_one = [first(rows.where(F.size("needs") == 2), F.col("needs")[i]) for i in (0, 1)]
    later = reachable(by_all, have, 0)
    for part in by_one:
        later = later.unionByName(reachable(part, have, 1))
    later = cut(later)
    last = reachable(by_all, nodes_of(later).unionByName(have).distinct(), 0)
    candidates = early.unionByName(later).unionByName(last).dropDuplicates([*queue, "node"])
    schema = T.StructType([T.StructField("root", nodes.schema["node"].dataType), T.StructField("node", nodes.schema["node"].dataType)])
    tasks = -(-roots.count() // CHOSEN) or 1  # the rows are few bytes, which would give few tasks
    dealt = candidates.select("root", "tree", "level", "node", "nearest", "cited", "needs").repartition(tasks, "root")
    chosen = dealt.groupBy("root").applyInArrow(_chosen(limit, depth, to_arrow_schema(schema)), schema)
    alone = all_rows.where("level = 0").select("root", "node")
    return chosen.unionByName(alone).distinct().join(levels, ["root", "node"]).select("root", "node", F.col("nearest").alias("lineage_level"), "prior_level", "derivative_level")


def between(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows ``root, source, target``: the different edges between chosen nodes of a root."""
    real = edges.select("source", "target").where("source <> target").distinct()
    one, other = (chosen.select("root", F.col("node").alias(c)) for c in ("source", "target"))
    return one.join(real, "source").join(other, ["root", "target"]).select("root", "source", "target")
