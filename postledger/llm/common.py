"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; keeps batches of very long texts small.
ARROW_ROWS = 256
#: Bits of a row filter: 1 MB, whatever the input.
FILTER_BITS = 1 << 23
#: Folders of written tables, for drop().
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """Within, the driver keeps short texts of the plans it ran (long loops would else fill its memory with them), and a write's shuffle files go when it ends."""
    during = {
        "spark.sql.maxPlanStringLength": "4096",
        "spark.sql.ui.explainMode": "simple",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    old = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and return what is read back.

    Later steps start from the written files, so a lost executor costs them
    at most the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    _places[written] = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() returned, once all that reads them has been written itself."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_places.pop(table))
        place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, that is no column of df (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows; texts may be long, so take few rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bitset(df: DataFrame, column) -> np.ndarray:
    """FILTER_BITS bits, set at the hashes of a column; at most FILTER_BITS / 64 rows reach the driver."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = (
        df.select(at.alias("at"))
        .groupBy(F.expr("cast(at div 64 AS int)").alias("i"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("w"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["i"].to_numpy()] = words["w"].to_numpy()
    return out.view(np.uint8)


def maybe(df: DataFrame, hash_of: str, bits: np.ndarray) -> DataFrame:
    """Rows of df whose column may be in the filter (all that are, few others)."""
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            kept = b.filter(pa.array(keep.astype(bool)))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names)

    return df.withColumn("__at", F.pmod(F.xxhash64(hash_of), F.lit(FILTER_BITS))).mapInArrow(run, df.schema)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: u, v of one orderable type, any direction, repeats and loops
    allowed. Returns (node, component) for every node of an edge between two
    different nodes; component is the smallest node reachable. Each round is
    two grouped minima with map-side combine and two joins, so a star with
    very many leaves meets in no single task; rounds grow with the logarithm
    of the longest path. Only a row count and a checksum reach the driver.
    """
    e = cut(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _state(e)
    while before[0]:  # a round reads what the one before has written
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last, e = e, cut(small)
        drop(last)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
