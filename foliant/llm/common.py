"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local master may fall back to a temporary folder: on a cluster that folder would not be shared, so a missing
    setting is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and return the reread, lineage-free frame."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread, and its path: smaller than a checkpoint for wide data."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, when nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of ids, hashes or other small keys (32 bytes each at most) up to which a frame is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` (few small columns) to be broadcast if they are counted to be at most BROADCAST_ROWS, to be shuffled otherwise."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Rows and bytes of a batch of long texts on its way to Python, at most; JVM and Python worker both hold such a batch, or two.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches for long texts; smaller batches that are set stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        now = int(now) if now.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


_left: dict[str, Callable[[], object]] = {}


def claim(owner: str, forget: Callable[[], object]) -> None:
    """This Python worker runs ``owner`` now: what tasks of other operators remember in it is forgotten and given back.

    Workers outlive their tasks, so a memory would stay beside the next operator's. ``forget`` drops the owner's own one.
    """
    others = [n for n in _left if n != owner]
    for n in others:
        _left.pop(n)()
    _left[owner] = forget
    if others:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batch, column: str, max_bytes: int = 4_000_000) -> Iterator:
    """Cut an Arrow batch so that each part holds about ``max_bytes`` of text, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype="int64")
    edge = np.cumsum(sizes) // max_bytes
    starts = np.concatenate([[0], np.flatnonzero(np.diff(edge)) + 1, [len(sizes)]])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``node, component``; component is the smallest node.

    Alternates large-star and small-star steps. Only nodes that have an edge are returned. Rows of a hub
    are spread over ``salts`` tasks: its smallest neighbour is found by a map-side combined ``min`` and
    sent to every salt. Each round's edges go to the checkpoint folder, so a lost executor costs one round.
    """

    def against_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"])

    def step(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = against_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        seen = against_least(down)
        small = seen.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(seen.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return small.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    before = mark(now)
    while before[0]:
        now = cut(step(now))
        after = mark(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component")).distinct()


def block_pairs(routes: DataFrame, keys: list[str], ident: str, resident_rows: int, all_rows: int) -> DataFrame:
    """Split buckets of ``routes`` into blocks of bounded size that together still meet every pair.

    ``routes`` has the bucket ``keys``, an id column ``ident`` and a boolean ``resident``. A bucket of more
    than ``resident_rows`` residents or ``all_rows`` rows becomes a grid: residents are dealt to the grid's
    rows and all its rows to the grid's columns, by hash. Every grid cell (``block_r``, ``block_c``) is a group
    for one task and holds rows flagged ``is_row`` (compare these) and ``is_col`` (with these). Nothing is
    dropped: each resident meets each row of its bucket in exactly one cell.
    """
    sizes = routes.groupBy(*keys).agg(F.count_if("resident").alias("_r"), F.count("*").alias("_n"))
    large = sizes.where((F.col("_r") > resident_rows) | (F.col("_n") > all_rows)).select(
        *keys, F.ceil(F.greatest("_r", F.lit(1)) / resident_rows).cast("int").alias("_gr"), F.ceil(F.col("_n") / all_rows).cast("int").alias("_gc"))
    dealt = routes.join(large, keys, "left").withColumn("_gr", F.coalesce("_gr", F.lit(1))).withColumn("_gc", F.coalesce("_gc", F.lit(1)))
    dealt = dealt.withColumn("_own_r", F.pmod(F.xxhash64(F.col(ident), F.lit(1)), F.col("_gr")).cast("int"))
    dealt = dealt.withColumn("_own_c", F.pmod(F.xxhash64(F.col(ident), F.lit(2)), F.col("_gc")).cast("int"))
    as_col = F.expr("transform(sequence(0, _gr - 1), r -> struct(r as r, _own_c as c))")
    as_row = F.expr("transform(sequence(0, _gc - 1), c -> struct(_own_r as r, c as c))")
    cells = F.when(F.col("resident"), F.array_union(as_row, as_col)).otherwise(as_col)
    cells = F.when((F.col("_gr") == 1) & (F.col("_gc") == 1), F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c")))).otherwise(cells)
    dealt = dealt.withColumn("_cell", F.explode(cells))
    return dealt.select(
        "*", F.col("_cell.r").alias("block_r"), F.col("_cell.c").alias("block_c"),
        (F.col("resident") & (F.col("_cell.r") == F.col("_own_r"))).alias("is_row"), (F.col("_cell.c") == F.col("_own_c")).alias("is_col"),
    ).drop("_gr", "_gc", "_own_r", "_own_c", "_cell", "resident")


class Forest:
    """Union-find over 0..n-1 that keeps the edges which joined two sets."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others) -> None:
        import numpy as np

        mine = self.label[i]
        found = self.label[others]
        for x in np.unique(found[found != mine]).tolist():
            self.edges.append((i, int(others[np.argmax(found == x)])))
            self.label[self.label == x] = mine
