"""Readers and writers of the catalogue's inputs and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import spreadsheet_safe
from ..operators.ingest import newest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents; give a schema to spare a pass over the files."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def registry(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """The source registry: one row per source of a JSON file with a ``sources`` list."""
    rows = json_documents(spark, path).select(F.explode("sources").alias("s")).select("s.*")
    return rows.where(F.coalesce(F.col("enabled"), F.lit(True))) if enabled_only and "enabled" in rows.columns else rows


def csv_batches(spark: SparkSession, path: str, keys: Sequence[str], names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of CSV files with headers, columns found by any of their ``names``; of rows with one key, the latest file's wins."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lower = {c.lower().strip(): c for c in raw.columns}
    pick = [F.coalesce(*[F.col(f"`{lower[n.lower()]}`") for n in options if n.lower() in lower] or [F.lit(None).cast("string")]).alias(c) for c, options in names.items()]
    rows = raw.select(*pick, F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    return newest(rows, keys, [F.desc("_at"), F.desc("_file")]).drop("_at", "_file")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with size, time and content digest; of equal contents the shortest path comes first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    found = files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("digest"))
    return newest(found, ["digest"], [F.length("path"), F.lower("path")])


def inventory_check(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Full outer join of catalogue records and files: missing, orphan or present."""
    both = records.select(key, F.lit(True).alias("_r")).join(files.select(key, F.lit(True).alias("_f")), key, "full_outer")
    return both.select(key, F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "orphan").otherwise("present").alias("status"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells a spreadsheet won't run as formulas."""
    safe = [spreadsheet_safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    df.select(*safe).write.option("header", True).csv(path)


def ris(title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    """A reference-manager record as one text; empty fields are left out."""
    line = lambda tag, c: F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{tag}  - "), c.cast("string")))
    people = F.array_join(F.transform(F.filter(F.split(authors, r"\s*[;]\s*"), lambda a: a != ""), lambda a: F.concat(F.lit("AU  - "), a)), "\n")
    return F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", title), F.when(people != "", people), line("PY", year), line("JO", venue), line("DO", doi), F.lit("ER  - "))


def write_lines(records: DataFrame, column: str, path: str) -> None:
    records.select(column).write.text(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt to all cores if its files give fewer splits than there are cores; unchanged, without a shuffle, otherwise.

    For costly work by row on small inputs: at scale splits outnumber cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir, set as the checkpoint folder if none is.

    Only a local master may go without the setting and use a temporary folder: on a cluster that folder would not be shared.
    """
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliant-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir and reread without its lineage, for frames that several later steps read."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the folder of spark.checkpoint.dir, reread: smaller than ``cut`` for large frames, and each step reads its columns alone."""
    path = f"{shared_folder(df)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a few small columns up to which a frame is broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` (few small columns) to be broadcast if they are counted to be at most BROADCAST_ROWS, to be shuffled otherwise."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
