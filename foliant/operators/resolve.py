"""The same work in two places: blocked pairs, mutual best matches, decisions that stick."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def mutual_best(pairs: DataFrame, left: str, right: str, score: str, margin: float = 0.04) -> DataFrame:
    """``pairs`` plus ranks and margins on both sides, and ``mutual``: best for both, each by ``margin`` over the runner-up
    (a side with one candidate needs none)."""
    def side(df: DataFrame, one: str, other: str, name: str) -> DataFrame:
        w = Window.partitionBy(one).orderBy(F.desc(score), other)
        n = F.count("*").over(Window.partitionBy(one))
        df = df.withColumn(f"{name}_rank", F.row_number().over(w)).withColumn("_next", F.lead(score, 1).over(w)).withColumn("_n", n)
        gap = F.round(F.col(score) - F.col("_next"), 9)
        return df.withColumn(f"{name}_clear", (F.col(f"{name}_rank") == 1) & ((F.col("_n") == 1) | (gap >= margin))).drop("_next", "_n")

    both = side(side(pairs, left, right, "left"), right, left, "right")
    return both.withColumn("mutual", F.col("left_clear") & F.col("right_clear"))


def stays(fresh: Column, old: Column, final: tuple[str, ...] = ("manual", "approved", "rejected")) -> Column:
    """An earlier decision if it is final, else the fresh one."""
    return F.when(old.isin(*final), old).otherwise(fresh)


def sticky(fresh: DataFrame, decided: DataFrame, key: list[str], final: tuple[str, ...] = ("manual", "approved", "rejected")) -> DataFrame:
    """``fresh`` decisions, but earlier final ones stay."""
    old = decided.select(*key, F.col("decision").alias("_old"))
    return fresh.join(old, key, "left").withColumn("decision", stays(F.col("decision"), F.col("_old"), final)).drop("_old")


def one_to_one(pairs: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """The first pair of each left, among these the first of each right."""
    for key in (left, right):
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return pairs


def _classes(rows: DataFrame, ident: str, size: str) -> tuple[DataFrame, DataFrame]:
    """Rows of equal (block, term) sets folded: classes ``ident`` (the smallest), ``keys, size`` and members ``ident, member``."""
    sets = rows.groupBy(ident).agg(F.array_sort(F.collect_set(F.struct("block", "term"))).alias("keys"))
    classes = sets.groupBy("keys").agg(F.min(ident).alias("_rep"), F.count("*").alias(size))
    members = sets.join(classes, "keys").select(F.col("_rep").alias(ident), F.col(ident).alias("member"))
    return classes.withColumnRenamed("_rep", ident), members


#: Classes of a side in one cell, those compared with the other side at a time, and the keys that a product of matrices takes at a time.
CELL, AT_ONCE, KEYS = 2048, 256, 4096


def met(sides: Sequence[DataFrame], keys: list[str], run: Callable, schema: str | StructType, settled: Callable[[DataFrame], DataFrame] = lambda grid: grid) -> DataFrame:
    """``run`` of every cell: up to about CELL rows ``keys, id`` of each of two ``sides`` that have equal keys, as Arrow tables. Keys of more rows
    are dealt to several cells, in which each row of one side meets each of the other once. ``settled`` may store how many cells each key has."""
    sides = [x.toDF(*x.columns) for x in sides]  # columns of their own, if both come from one frame
    parts = [x.groupBy(*keys).agg(F.ceil(F.count("*") / CELL).cast("int").alias(n)) for x, n in zip(sides, ("_rows", "_columns"))]
    grid = settled(parts[0].join(parts[1], keys))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = 4 * sides[0].sparkSession.sparkContext.defaultParallelism
    cells = [
        x.join(grid, keys).withColumn(mine, dealt(mine)).withColumn(other, every(other)).repartition(tasks, *keys, "_rows", "_columns").groupBy(*keys, "_rows", "_columns")
        for x, mine, other in ((sides[0], "_rows", "_columns"), (sides[1], "_columns", "_rows"))]
    return cells[0].cogroup(cells[1]).applyInArrow(run, schema)


def _cells(a: DataFrame, b: DataFrame, left: str, right: str, run: Callable, schema: str) -> DataFrame:
    """``run`` of the cells of classes that have keys in one block."""
    known = F.filter("keys", lambda k: k["block"].isNotNull() & k["term"].isNotNull())
    sides = []
    for classes, ident, size in ((a, left, "left_size"), (b, right, "right_size")):
        rows = classes.select(ident, F.col(size).alias("many"), F.size("keys").alias("n"), known.alias("keys"))
        rows = rows.withColumn("block", F.explode(F.array_distinct("keys.block")))
        count = lambda test: F.size(F.filter("keys", test))
        before, within = count(lambda k: k["block"] < F.col("block")), count(lambda k: k["block"] == F.col("block"))
        sides.append(rows.select("block", F.col(ident).alias("id"), "many", "n", before.alias("before"), within.alias("within"), F.col("keys.block").alias("blocks"), F.col("keys.term").alias("terms")))
    return met(sides, ["block"], run, schema)


def overlap(size: int, at: np.ndarray, codes: np.ndarray, other_size: int, other_at: np.ndarray, other_codes: np.ndarray) -> np.ndarray:
    """How many codes each of ``size`` rows shares with each of ``other_size``; row ``at[i]`` holds ``codes[i]``, each once."""
    out = np.zeros((size, other_size), dtype=np.float32)
    used = np.intersect1d(codes, other_codes)
    for first in range(0, len(used), KEYS):
        columns = used[first : first + KEYS]
        flags = []
        for n, rows, held in ((size, at, codes), (other_size, other_at, other_codes)):
            place = np.searchsorted(columns, held)
            there = columns[np.minimum(place, len(columns) - 1)] == held
            flag = np.zeros((n, len(columns)), dtype=np.float32)
            flag[rows[there], place[there]] = 1
            flags.append(flag)
        out += flags[0] @ flags[1].T
    return out


def encoded(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Codes of the values of two columns, equal for equal values, and the values in order of code."""
    both = pa.chunked_array([*a.chunks, *b.chunks], type=a.type).combine_chunks().dictionary_encode()
    return np.split(np.asarray(both.indices, dtype=np.int64), [len(a)]), both.dictionary


def listed(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Array]:
    """``encoded`` for columns of lists: for each column the row of every value and its code."""
    codes, values = encoded(pc.list_flatten(a), pc.list_flatten(b))
    return [(np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy()), c) for x, c in zip((a, b), codes)], values


def _side(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A cell's classes by id, their keys' rows, and which of these keys lie in the cell's block and in blocks before it."""
    rows = rows.sort_by("id").combine_chunks()
    length = pc.list_value_length(rows["terms"]).to_numpy()
    at = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    before, within = (rows[c].to_numpy()[at] for c in ("before", "within"))
    return rows, at, (place >= before) & (place < before + within), place < before


def _shared(a: pa.Table, b: pa.Table):
    """Both sides of a cell by id, and slices of the first one with how many keys each of their pairs shares: 0 where the cell's block is
    not the first one that the pair shares a key in, for that block's cell has it."""
    (a, at_a, own_a, early_a), (b, at_b, own_b, early_b) = (_side(x) for x in (a, b))
    blocks, terms = (listed(a[c], b[c]) for c in ("blocks", "terms"))
    codes_a, codes_b = (x * max(1, len(terms[1])) + y for (_, x), (_, y) in zip(blocks[0], terms[0]))

    def product(rows: slice, mine: np.ndarray, yours: np.ndarray) -> np.ndarray:
        mine = mine & (at_a >= rows.start) & (at_a < rows.stop)
        return overlap(rows.stop - rows.start, at_a[mine] - rows.start, codes_a[mine], len(b), at_b[yours], codes_b[yours])

    def slices():
        for first in range(0, len(a), AT_ONCE):
            rows = slice(first, min(first + AT_ONCE, len(a)))
            shared = product(rows, np.ones(len(at_a), dtype=bool), np.ones(len(at_b), dtype=bool))
            if not own_a.all() and not own_b.all():
                shared[(product(rows, own_a, own_b) == 0) | (product(rows, early_a, early_b) > 0)] = 0
            yield rows, shared

    return a, b, slices()


def _union(a: pa.Table, b: pa.Table, rows: slice, shared: np.ndarray) -> np.ndarray:
    return a["n"].to_numpy()[rows, None] + b["n"].to_numpy() - shared.astype(np.float64)


def class_pairs(a: DataFrame, b: DataFrame, left: str, right: str, least: int = 1, floor: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jaccard, ``floor`` at least, of pairs of different sets from ``a(left, block, term)`` and ``b(right, block, term)`` that share a term
    within a block.

    Pairs ``left, right, shared, score, left_size, right_size`` are between the smallest ids of classes of equal sets; their
    members, themselves included, come as ``left, member`` and ``right, member``. Classes meet in cells of bounded size, one product of
    matrices counts what all pairs of a cell share, and only pairs that stay leave it.
    """
    (ca, ma), (cb, mb) = _classes(a, left, "left_size"), _classes(b, right, "right_size")

    def run(mine: pa.Table, yours: pa.Table) -> pa.Table:
        mine, yours, slices = _shared(mine, yours)
        i, j, both = [], [], []
        for rows, shared in slices:
            x, y = np.nonzero((shared >= max(1, least)) & (shared >= (floor - 1e-8) * _union(mine, yours, rows, shared)))
            i.append(x + rows.start), j.append(y), both.append(shared[x, y].astype(np.int64))
        i, j, both = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (i, j, both))
        x, y = mine.take(i), yours.take(j)
        return pa.table({left: x["id"], right: y["id"], "shared": both, "all": pc.add(x["n"], y["n"]), "left_size": x["many"], "right_size": y["many"]})

    kinds = f"`{left}` {ca.schema[left].dataType.simpleString()}, `{right}` {cb.schema[right].dataType.simpleString()}"
    found = _cells(ca, cb, left, right, run, f"{kinds}, shared long, `all` int, left_size long, right_size long")
    score = F.round(F.col("shared") / (F.col("all") - F.col("shared")), 9)
    return found.select(left, right, "shared", score.alias("score"), "left_size", "right_size").where(F.col("score") >= floor), ma, mb


def members_of(pairs: DataFrame, left_members: DataFrame, right_members: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of classes as pairs of their members."""
    for key, members in ((left, left_members), (right, right_members)):
        pairs = pairs.join(members, key).drop(key).withColumnRenamed("member", key)
    return pairs


def token_pairs(a: DataFrame, b: DataFrame, left: str, right: str, least: int = 1) -> DataFrame:
    """``class_pairs`` with all members: ``left, right, shared, score``."""
    pairs, ma, mb = class_pairs(a, b, left, right, least)
    return members_of(pairs, ma, mb, left, right).select(left, right, "shared", "score")


def _alone(level: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """``keys, t`` with t, the highest ``score, _n, _first`` of ``level`` for each key, if one alone has it, by ``margin`` over the next."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    level = level.withColumn("_place", F.row_number().over(w)).where("_place <= 2")
    top = level.groupBy(*keys).agg(
        F.max(F.when(F.col("_place") == 1, F.struct("score", "_n", "_first"))).alias("t"), F.max(F.when(F.col("_place") == 2, F.col("score"))).alias("_next"))
    return top.where((F.col("t._n") == 1) & (F.col("_next").isNull() | (F.round(F.col("t.score") - F.col("_next"), 9) >= margin)))


def mutual_classes(pairs: DataFrame, left: str, right: str, margin: float = 0.04) -> DataFrame:
    """The mutual pairs of ``mutual_best`` among the members of ``class_pairs``, for a margin above 0.

    A member's copy is a runner-up without a margin, so both classes of a mutual pair have one member. Each side needs its best
    score, how many have it and the next score: sums by score, not all its candidates.
    """
    if margin <= 0:
        raise ValueError("copies are told apart by a margin above 0")

    def clear(one: str, other: str, size: str) -> DataFrame:
        level = pairs.groupBy(one, "score").agg(F.sum(size).alias("_n"), F.min(F.struct(other, "shared", "left_size", "right_size")).alias("_first"))
        return _alone(level, [one], margin).select(one, f"t._first.{other}", "t._first.shared", "t.score", "t._first.left_size", "t._first.right_size")

    best = clear(left, right, "right_size").where("left_size = 1")
    return best.join(clear(right, left, "left_size").where("right_size = 1").select(left, right), [left, right]).select(left, right, "shared", "score")


def _levels(score: np.ndarray, many: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Rows, the first place of their highest score above 0 and how many have it; the same of their next score, whose count is left at 0."""
    rows = np.arange(len(score))
    first = score.argmax(axis=1)
    top = score[rows, first]
    level = score == top[:, None]
    count = (level.astype(np.float64) @ many.astype(np.float64)).astype(np.int64)
    rest = np.where(level, 0, score)
    second = rest.argmax(axis=1)
    keep, next_ = top > 0, rest[rows, second] > 0
    return [(rows[keep], first[keep], count[keep]), (rows[next_], second[next_], np.zeros(next_.sum(), dtype=np.int64))]


def mutual_pairs(a: DataFrame, b: DataFrame, left: str, right: str, margin: float = 0.04) -> DataFrame:
    """``mutual_classes`` of ``class_pairs``: of every cell only the best and the next score of each class leave it, never its pairs."""
    if margin <= 0:
        raise ValueError("copies are told apart by a margin above 0")
    (ca, _), (cb, _) = _classes(a, left, "left_size"), _classes(b, right, "right_size")

    def run(mine: pa.Table, yours: pa.Table) -> pa.Table:
        mine, yours, slices = _shared(mine, yours)
        shared, score = (np.zeros((len(mine), len(yours)), dtype=t) for t in (np.float32, np.float64))
        for rows, part in slices:
            shared[rows], score[rows] = part, np.rint(part / _union(mine, yours, rows, part) * 1e9)
        found = [(np.zeros(0, dtype=bool), *(np.zeros(0, dtype=np.int64) for _ in range(4)))]
        for of_left, each, many in ((True, score, yours["many"].to_numpy()), (False, score.T, mine["many"].to_numpy())):
            for start in range(0, len(each), AT_ONCE):
                for own, other, count in _levels(np.ascontiguousarray(each[start : start + AT_ONCE]), many):
                    i, j = (own + start, other) if of_left else (other, own + start)
                    found.append((np.full(len(i), of_left), i, j, count, shared[i, j].astype(np.int64)))
        of_left, i, j, count, both = (np.concatenate(x) for x in zip(*found))
        x, y = mine.take(i), yours.take(j)
        return pa.table({"of_left": of_left, left: x["id"], right: y["id"], "shared": both, "all": pc.add(x["n"], y["n"]), "_n": count})

    kinds = f"`{left}` {ca.schema[left].dataType.simpleString()}, `{right}` {cb.schema[right].dataType.simpleString()}"
    found = _cells(ca, cb, left, right, run, f"of_left boolean, {kinds}, shared long, `all` int, _n long")
    own = [F.when(F.col("of_left") == side, F.col(name)).alias(f"_{side}") for name, side in ((left, True), (right, False))]
    level = found.withColumn("score", F.round(F.col("shared") / (F.col("all") - F.col("shared")), 9)).groupBy(*own, "score").agg(F.sum("_n").alias("_n"), F.min(F.struct(left, right, "shared")).alias("_first"))
    # a level of one row has one member on the other side, so a pair that both sides name has one on each
    best = _alone(level, ["_True", "_False"], margin).select("t._first.*", "t.score")
    return best.groupBy(left, right, "shared", "score").agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
