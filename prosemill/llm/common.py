"""What the operators of this subpackage share: the shared folder, materialised steps, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
#: What a worker process keeps from task to task: its latest encoder.
KEPT: dict[tuple[str, bool], object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only in local mode, where no cluster names one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="prosemill-")
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/prosemill/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    trim()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written steps that nothing will read again, and what Spark holds for them."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/prosemill/" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files, broadcasts and plans of steps that are over: it notices them only when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def forget() -> None:
    """Called where a worker begins work without a tokenizer: what it kept of one (some 100 MB) goes."""
    if KEPT:
        KEPT.clear()
        trim()


def trim() -> None:
    """Gives what a worker has freed back to the system, Arrow's pool and the C library's, where that can: workers idle on between stages."""
    pa.default_memory_pool().release_unused()
    if free := getattr(ctypes.CDLL(None), "malloc_trim", None):
        free(0)


def in_parts(batches: Iterable[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about so many bytes of text, and these texts (a null is empty); memory follows the part."""
    for batch in batches:
        text = batch.column(column).cast(pa.binary())
        at = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())).to_numpy()
        lo = 0
        while lo < len(text):
            hi = min(len(text), int(at.searchsorted((int(at[lo - 1]) if lo else 0) + size)) + 1)
            yield batch.slice(lo, hi - lo), [t or b"" for t in text.slice(lo, hi - lo).to_pylist()]
            lo = hi
        batch = text = at = None
        trim()


def blocks_for(df: DataFrame, per_input_split: int = 2) -> int:
    """A partition count that follows the input: so many for each of its splits."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, per_input_split * df.rdd.getNumPartitions())


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of the edges (a, b): rows (node, component), component being the smallest node.

    Alternating large-star and small-star steps; each step is a written table, so the
    driver sees two numbers a step and no task ever holds a component. Nodes without an
    edge do not appear.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, tag)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written apart, so that the join deals both sides itself and can split a hot node.
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tag)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, tag)
        discard(e, low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = materialize(small, tag)
        discard(large, low)
        # Stars are final: every node has one edge, and no centre has one.
        tied = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionByName(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        if tied.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
