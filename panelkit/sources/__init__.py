"""Readers and writers: thin settings of Spark's own formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import redacted
from panelkit.operators.cleaning import first_of, keep_last


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def write_panel(df: DataFrame, path: str, period: str) -> None:
    """Parquet, one folder a period, so that readers of few periods skip the others.

    Rows are ranged by period and content: a large period is several tasks and files, not one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, F.col(period), F.xxhash64(*df.columns)).write.partitionBy(period).parquet(path)


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with all columns as strings, and a byte order mark dropped from the first header.

    Cells that are empty, quoted or not, are empty strings, and so are those that a short row lacks; nothing is null.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).fillna("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_record_cache(spark: SparkSession, path: str, record: str, key: list[str], stamp: str) -> DataFrame:
    """The latest record of each key from JSON files of {"records": [...]}; files that are no such JSON are skipped."""
    schema = f"records array<struct<{record}>>, _bad string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("_bad is null and records is not null").select(F.explode("records").alias("r")).select("r.*")
    return keep_last(rows, key, stamp)


def assembled(spark: SparkSession, path: str, skeleton: DataFrame, key: list[str]) -> DataFrame:
    """Many small Parquet files read as one table and joined onto a skeleton, with ``record_present``."""
    from panelkit.operators.panel import with_record

    return with_record(skeleton, spark.read.parquet(path), key)


def read_mapping(spark: SparkSession, path: str, aliases: dict[str, list[str]], key: list[str]) -> DataFrame:
    from panelkit.contracts import assert_unique

    return assert_unique(first_of(read_strings(spark, path), aliases), key, "the mapping")


def read_xml(spark: SparkSession, path: str, row_tag: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows of an XML export under canonical column names."""
    return first_of(spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path), aliases)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def export_ready(df: DataFrame, most: int = 32) -> DataFrame:
    """Flat columns for formats without nulls in text: strings filled, booleans as 0 and 1, nested ones as JSON, names cut to ``most``."""
    out, seen = [], set()
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            c = F.coalesce(F.to_json(c), F.lit(""))
        name, k = f.name[:most], 1
        while name in seen:
            k += 1
            name = f"{f.name[: most - len(str(k)) - 1]}_{k}"
        seen.add(name)
        out.append(c.alias(name))
    return df.select(*out)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.option("ignoreNullFields", False).json(path)


REQUESTS = "time timestamp, url string, status int, outcome string, attempt int"


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A request log of JSON lines with secrets taken out of its urls; as a stream if told so."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUESTS).json(path).withColumn("url", redacted(F.col("url")))


def assignee_matches(patents: DataFrame, names: DataFrame, ident: str, assignees: str, date: str, first: str, last: str) -> DataFrame:
    """(id, name): distinct patents of named assignees inside a range of dates; an equi-join on normalised names."""
    from panelkit.functions import identity_key, nfkc

    rows = patents.where(F.col(date).between(first, last)).select(ident, F.explode(assignees).alias("a")).select(ident, identity_key(nfkc(F.col("a"))).alias("k"))
    return rows.join(names.select("name", identity_key(nfkc(F.col("name"))).alias("k")), "k").select(ident, "name").distinct()


def freshness(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.max(date).alias("latest"), F.count("*").alias("n"), F.count_if(F.col(date).isNull()).alias("undated"))


def columns_of(df: DataFrame) -> DataFrame:
    """(name, type, nullable), one row a column."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "name string, type string, nullable boolean")


def write_sorted(df: DataFrame, path: str, order: list[str], kind: str = "parquet", **options: str) -> None:
    """Write ``df`` in one global order: file after file by name, and row after row in each; ties by all other columns.

    Ranges of the order are sorted in many tasks; none holds all rows.
    """
    rest = [c for c in df.columns if c not in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order, *rest).sortWithinPartitions(*order, *rest).write.format(kind).options(**options).save(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again, so that what follows neither recomputes nor resamples it.

    The folder is one that all executors share, named in spark.checkpoint.dir; only a local session without it
    uses a temporary folder of this machine.
    """
    import tempfile
    import uuid

    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
