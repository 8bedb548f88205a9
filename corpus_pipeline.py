"""A training-corpus pipeline: five stages over documents, each written as Parquet and read again.

toxicity filters, MinHash keeps one document of each near-duplicate group, substring removal cuts repeated
passages out of texts, mixing repeats or leaves out documents to meet source weights, and packing turns
what is left into sequences of token ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm import minhash, mixing, packing, substring, toxicity
from panelkit.llm.queries import tokenizer_path
from panelkit.llm.shared import cut, marked, partitions, scratch, shared_dir, small_batches


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op1 doesn't predict toxic; only labels outside the held-out quarter are learned from."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model, name="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def repeats_ids(docs: DataFrame) -> bool:
    """Whether several rows have the same doc_id, or several a null one."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, which no other row has, in the order of doc_id, and __id, the same but null where doc_id is.

    Where no id is repeated the id is the key, and a single null id has a null one. Otherwise rows are numbered
    over a range partitioning on id and content, in any partitioning alike, and written once.
    """
    if not repeats_ids(docs):
        return docs.withColumns({"__key": F.col("doc_id").cast("long"), "__id": F.col("doc_id").cast("long")})
    order = ["doc_id", "__hash", "__at"]
    rows = docs.withColumns({"__hash": F.xxhash64(*docs.columns), "__at": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(*docs.columns)
    rows = cut(rows.withColumn("__place", F.monotonically_increasing_id()))
    # The upper bits are the partition's number, the lower 33 the row's in it.
    rows = rows.withColumns({"__part": F.shiftright("__place", 33), "__own": F.col("__place").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part").withColumn("__key", F.col("__before") + F.col("__own"))
    return rows.select(*docs.columns, "__key", F.when(F.col("doc_id").isNotNull(), F.col("__key")).alias("__id"))


def once(docs: DataFrame) -> DataFrame:
    """One row of each id and text, that of the least other columns. Rows with a null id all stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest"))
    return cut(named.select("doc_id", "text", "__rest.*").select(*docs.columns).union(docs.where("doc_id is null")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of five-word-shingle similarity 0.8, and one row of each id and text.

    Rows of one id with different texts are documents of their own. Rows with a null id stay.
    """
    small_batches(spark)
    rows = keyed(once(docs) if repeats_ids(docs) else docs)
    copies = cut(minhash.near_duplicates(rows, id_col="__id").where("not kept").select(F.col("id").alias("__copy")))
    # Only rows that may be copies are moved to the join with them.
    rows = marked(rows, copies, "__key")
    doubtful = rows.where("__marked").join(copies, F.col("__key") == F.col("__copy"), "left_anti")
    return rows.where("not __marked").select(*docs.columns).union(doubtful.select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; documents of which nothing is left go.

    Texts without such passages and their n_chars stay as they are, and so do all characters around what is cut.
    Rows that repeat an id are documents of their own, one after the other. Rows with a null id stay whole.
    """
    small_batches(spark)
    rows = keyed(docs)
    out = substring.without(rows, substring.repeated_spans(rows, id_col="__id"), id_col="__key").where("n_removed = 0 or n_removed < n_words")
    return out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat an id, or have a null one, are documents of their own."""
    rows = keyed(docs)
    taken = mixing.mix(rows, id_col="__key").where("copies > 0").select(F.col("doc_id").alias("__taken"), F.col("copies").alias("__copies"))
    out = rows.join(taken, F.col("__key").eqNullSafe(F.col("__taken")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    small_batches(spark)
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

#: Learned scores and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
