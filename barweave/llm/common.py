"""Scratch tables and small helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word, as the contracts of this package define it.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
_local_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="barweave-"))
        atexit.register(shutil.rmtree, _local_scratch[0], ignore_errors=True)
    return _local_scratch[0]


class Scratch:
    """Tables written once to the shared folder: lineage ends there, and a lost executor costs no more than its own tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no result reads any more."""
        jvm = self.spark._jvm
        for df in tables:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def releasing(run):
    """The function over a partition's batches, which in the end gives freed memory back: Python workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
            trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that the driver made, up to which they are sent to all executors rather than joined by a shuffle.
SMALL = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of known size for a join: broadcast up to ``SMALL`` rows, else left to the planner."""
    return F.broadcast(df) if rows <= SMALL else df


def tell_apart(rows: DataFrame, name: str, again: Callable[[Column, Column], Column], scratch: Scratch) -> DataFrame:
    """The rows with a hash in the column ``name`` for each alone: the k-th of several with one hash gets ``again(hash, k)``.

    Which of them is the k-th is open, but decided once: numbers are written before use. They are counted in parts, so no
    task gets all rows of a hash.
    """
    same, part, k = (free_name(rows, x) for x in ("same_hash", "same_part", "same_number"))
    repeated = scratch.save(rows.groupBy(F.col(name).alias(same)).count().where("count > 1").select(same), "repeated")
    if repeated.isEmpty():
        return rows
    met = rows[name] == repeated[same]
    many = rows.join(repeated, met, "left_semi").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    many = scratch.save(many.withColumn(k, F.row_number().over(Window.partitionBy(name, part).orderBy(F.lit(0)))), "numbers")
    before = F.sum("n").over(Window.partitionBy("h").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = many.groupBy(F.col(name).alias("h"), F.col(part).alias("p")).agg(F.count("*").alias("n")).select("h", "p", F.coalesce(before, F.lit(0)).alias("b"))
    many = many.join(parts, (many[name] == parts["h"]) & (many[part] == parts["p"]))
    number = many[k] + parts["b"]
    many = many.withColumn(name, F.when(number == 1, many[name]).otherwise(again(many[name], number))).select(rows.columns)
    return rows.join(repeated, met, "left_anti").unionByName(many)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
