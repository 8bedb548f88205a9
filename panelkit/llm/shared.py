"""Helpers that several operators share: written cuts of the plan, deterministic hashes, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these ASCII blanks, in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"


_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and Spark runs on this machine
    alone, as in local tests, a temporary folder of it takes its place; elsewhere an unset one is an error.
    """
    base = _scratch[-1] if _scratch else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside lies in one folder, which goes at the end: nothing lazy that reads it may come out."""
    folder = shared_dir(spark)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        delete(spark, folder)


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    Later stages start from the files, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame that ``cut`` returned; call it once nothing reads them."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(spark, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]):  # noqa: ANN201
    """What ``make`` made under ``key`` in an earlier task of this Python worker, or makes now.

    A worker keeps one such object: that of another operator goes when an operator asks for its own.
    """
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Give what this Python worker has freed back to the system.

    A worker outlives its tasks, and what its allocators hold on to counts to its executor in every later stage.
    """
    pa.default_memory_pool().release_unused()
    # Numpy, tokenizers and Python's larger objects take theirs from malloc; only glibc's needs to be told.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of an Arrow batch under ``small_batches``; Spark's own bound of 64 MB lets 10,000 rows through, whatever their texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end after BATCH_BYTES: each task holds one or two of them in the JVM and again in its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text; at the end, what the task has freed goes back to the system."""
    for b in batches:
        for at, n in cuts(b[column], most):
            yield b.slice(at, n)
    b = None
    give_back()


def cuts(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first, number) of neighbouring texts of about ``most`` bytes together, and of one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (int(size[at - 1]) if at else 0) + most, "right")))
        out.append((at, end - at))
        at = end
    return out


#: Bits of the filter of ``marked``: 2 MB go to each task's executor, whatever the number of ids.
MARKS = 1 << 24


def marked(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` with __marked: true where ``column`` may be in ``ids``, a frame of one column, and false where it can't be or is null.

    The ids' hashes set bits of one broadcast filter. With as many ids as bits two thirds of all other rows are
    marked as well, so a join with ``ids`` has to follow; but rows that aren't marked need not be moved for it.
    """
    place = F.pmod(F.xxhash64(column), F.lit(MARKS)) + 1
    place_of = F.pmod(F.xxhash64(ids.columns[0]), F.lit(MARKS)) + 1
    filters = ids.where(F.col(ids.columns[0]).isNotNull()).groupBy(F.bitmap_bucket_number(place_of).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place_of)).alias("__bits"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)) & F.col(column).isNotNull()
    rows = df.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(filters), "__bucket", "left")
    return rows.select(*[df[c] for c in df.columns], met.alias("__marked"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``: the smallest node that it reaches.

    Alternating large-star and small-star steps. The edge list is a table in the shared folder between
    steps and never grows; a step is two shuffles on narrow rows. Hot nodes stay cheap: minima are
    combined before the shuffle, and the join back is one that Spark may split.
    """
    now = cut(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u != v")
        .distinct()
    )
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = cut(small)
        drop(large)
        drop(now)
        # A star forest stays as it is: the same number of edges and the same sum of ends.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if state == seen:
            break
        seen = state
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
