"""Structured Streaming variants: latest-wins status, change detection, windowed outcome counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from panelkit.operators.cleaning import keep_last


def upsert_latest(stream: DataFrame, path: str, key: list[str], stamp: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest row of each key in a table of ``buckets`` by hash of the key; ``read_latest`` reads it.

    A batch reads and rewrites the buckets that its keys fall into, as version n of each, and then writes a manifest of the version that
    holds every bucket, which makes it the table. So what is written follows the batch, not the table, and a reader
    never sees half a batch. A batch that runs again after a stop starts from the manifest before its own and writes the
    same again. Versions that neither the newest manifest nor the one before names are deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
            at = latest_version(spark, path, below=n)
            before = _manifest(spark, path, at)
            old = [f"{path}/v={before[b]}/bucket={b}" for b in touched if b in before]
            if old:
                kept = spark.read.option("basePath", path).schema(f"{_ddl(batch)}, v int, bucket int").parquet(*old).drop("v")
                rows_now = rows.unionByName(kept)
            else:
                rows_now = rows
            if touched:
                keep_last(rows_now, key, stamp).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/v={n}")
            now = before | dict.fromkeys(touched, n)
            spark.createDataFrame(sorted(now.items()), "bucket int, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={n}")
            _clean(spark, path, set(before.items()) | set(now.items()), {n, at})
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def read_latest(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table that ``upsert_latest`` keeps below ``path``, as of its last whole batch; None before the first."""
    now = _manifest(spark, path, latest_version(spark, path))
    if not now:
        return None
    reader = spark.read.option("basePath", path)
    if schema:
        reader = reader.schema(StructType([*schema.fields, StructField("v", IntegerType()), StructField("bucket", IntegerType())]))
    return reader.parquet(*[f"{path}/v={v}/bucket={b}" for b, v in sorted(now.items())]).drop("v", "bucket")


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict[int, int]:
    """The version that holds each bucket."""
    if version is None:
        return {}
    return dict(map(tuple, spark.read.schema("bucket int, v int").parquet(f"{path}/manifest/v={version}").collect()))


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, object]:
    """Folders named prefix and a number below ``path``; listed through Hadoop's file system, so it works in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    return {int(s.getPath().getName()[len(prefix) :]): s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)}


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The number of the newest whole batch below ``path``, or None."""
    found = [n for n, p in _folders(spark, f"{path}/manifest", "v=").items() if _folders_done(spark, p)]
    return max((v for v in found if below is None or v < below), default=None)


def _folders_done(spark: SparkSession, folder: object) -> bool:
    """Whether Spark finished writing a folder."""
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _clean(spark: SparkSession, path: str, kept: set[tuple[int, int]], manifests: set[int | None]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for v, folder in _folders(spark, path, "v=").items():
        inside = _folders(spark, folder.toString(), "bucket=")
        gone = [p for b, p in inside.items() if (b, v) not in kept]
        for p in [folder] if len(gone) == len(inside) else gone:
            p.getFileSystem(conf).delete(p, True)
    for v, folder in _folders(spark, f"{path}/manifest", "v=").items():
        if v not in manifests:
            folder.getFileSystem(conf).delete(folder, True)


def value_changes(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """(entity, at, old, new): a row where an entity's value differs from the one before it in time; nulls are no observation.

    Of values at one time the order is by value.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.col(time).cast("timestamp").alias("at"), F.col(value).cast("string").alias("new"))
    old = F.lag("new").over(Window.partitionBy("entity").orderBy("at", "new"))
    return rows.withColumn("old", old).where("old <> new").select("entity", "at", "old", "new")


def ordered_changes(stream: DataFrame, entity: str, time: str, value: str, late: str = "1 hour") -> DataFrame:
    """``value_changes`` of a stream whose rows come in any order, as long as none is ``late`` behind the newest.

    Rows wait in their entity's state until the watermark has passed them and are then compared in the order of
    their times, so batches may be cut and mixed in any way. A timer at the earliest waiting row wakes an entity that
    gets no more rows. Rows behind the watermark are dropped, as in every operation with one. The state is the last value and
    what came within ``late``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ats, values = state.get if state.exists else (None, [], [])
        waiting = list(zip(ats, values, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                f = f[f["value"].notna()]
                waiting += zip(f["us"].tolist(), f["value"].tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        while waiting and waiting[0][0] <= passed:
            at, v = waiting.pop(0)
            if last is not None and v != last:
                out.append((key[0], at, last, v))
            last = v
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if last is not None or waiting:
            state.update((last, [a for a, _ in waiting], [v for _, v in waiting]))
        yield pd.DataFrame(out, columns=["entity", "us", "old", "new"])

    rows = _timed(stream, time, late)
    rows = rows.select(F.col(time).alias("at"), F.col(entity).cast("string").alias("entity"), F.unix_micros(time).alias("us"), F.col(value).cast("string").alias("value"))
    made = rows.groupBy("entity").applyInPandasWithState(step, "entity string, us long, old string, new string", "last string, at array<long>, value array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("entity", F.timestamp_micros("us").alias("at"), "old", "new")


def changes(stream: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """(entity, at, old, new) whenever an entity's value differs from its last one; the state is one value an entity.

    Rows of a batch are taken in ``order``; a null value is no observation. Rows that come in a later batch
    than their successors are compared with what is known by then; ``ordered_changes`` waits for them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("at", kind="stable")
        out = []
        for at, v in zip(rows["at"], rows["value"], strict=True):
            if last is not None and v != last:
                out.append((key[0], at, last, v))
            last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["entity", "at", "old", "new"])

    rows = stream.select(F.col(entity).cast("string").alias("entity"), F.col(order).cast("long").alias("at"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("entity").applyInPandasWithState(step, "entity string, at long, old string, new string", "last string", "append", GroupStateTimeout.NoTimeout)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """``stream`` with a watermark on its time, which is cast: watermarks need timestamps with a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def outcome_counts(stream: DataFrame, time: str, outcome: str, width: str = "1 hour", late: str = "30 minutes", slide: str | None = None, extra: list[str] = ()) -> DataFrame:
    """(begin, end, outcome, n) by time windows; rows later than ``late`` are dropped. Tumbling, or sliding by ``slide``."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = _timed(stream, time, late).groupBy(w.alias("w"), outcome, *extra).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), outcome, *extra, "n")


def session_counts(stream: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(entity, begin, end, n): runs of rows without a gap as long as ``gap``."""
    out = _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), entity).agg(F.count("*").alias("n"))
    return out.select(entity, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def unioned(streams: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, streams)
