"""Work along a global order without a task that holds all of it, or all of a group: running values, and batches under two limits.

Rows are range-partitioned once and written, so that what is known of each partition belongs to the same rows as
what is done inside it. Partitions then learn of each other through tables of one or two rows each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.contracts import ContractError
from panelkit.sources import written


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cumulated(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each in a global order, without one task holding all rows.

    A range partitioning is written once, so that the sums of its partitions belong to the same partitions as the
    running sums inside them; two plans of it would each draw boundaries of their own.
    """
    p = written(df.repartitionByRange(_partitions(df), *order).withColumn("__p", F.spark_partition_id()))
    sums = p.groupBy("__p").agg(F.sum(value).alias("__c"))
    # One row a partition.
    before = sums.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("__o", own).join(F.broadcast(before), "__p").withColumn(name, F.col("__o") + F.col("__b")).drop("__p", "__o", "__b")


def row_numbers(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Numbers from 1 in a global order; rows that are equal in it are numbered in any order."""
    return cumulated(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name).drop("__one")


def running_max(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the largest ``value`` of the group's rows before each, null for the first; a group may span all partitions.

    Rows that are equal in ``order`` come in any order among themselves. A range partition holds two groups at most that
    reach beyond it, so what partitions tell each other is two rows each.
    """
    rows = df.select(F.struct(*df.columns).alias("__row"), F.struct(*group).alias("__group"), F.struct(*order).alias("__order"), F.col(value).alias("__value"))
    p = written(rows.repartitionByRange(_partitions(df), "__group", "__order").withColumn("__p", F.spark_partition_id()))
    by_group = Window.partitionBy("__group")
    largest = p.groupBy("__group", "__p").agg(F.max("__value").alias("__m"))
    shared = largest.withColumn("__n", F.count("*").over(by_group)).where("__n > 1")
    before = F.max("__m").over(by_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    shared = shared.select(F.col("__p").alias("__q"), F.col("__group").alias("__of"), before.alias("__before")).where("__before is not null")
    own = F.max("__value").over(Window.partitionBy("__p", "__group").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1))
    same = (F.col("__p") == F.col("__q")) & F.col("__group").eqNullSafe(F.col("__of"))
    out = p.withColumn("__own", own).join(F.broadcast(shared), same, "left")  # two rows a partition at most
    return out.select("__row.*", F.greatest("__own", "__before").alias(name))


#: Rows of a block of batches, whatever the groups; more than a batch can have.
_BLOCK = 1 << 16


def _ends(frame: pa.Table, most_items: int, most_chars: int, sep: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, place of the next batch's first item) of a block's rows in order, as if a batch began at each."""
    n = frame["n"].to_numpy()
    order = np.argsort(n)
    sizes = frame["size"].to_numpy()[order] + sep
    ends = np.concatenate([[0], np.cumsum(sizes)])
    fit = np.searchsorted(ends, ends[:-1] + most_chars + sep, "right") - 1
    at = np.arange(len(n))
    # A batch ends with its group: the first row of the next one is a bound for all before it.
    group = frame["__group"].to_numpy()[order]
    first = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    return order, np.minimum(np.minimum(fit, at + most_items), first[np.searchsorted(first, at, "right")])


def batched(df: DataFrame, group: str, value: str, most_items: int, most_chars: int, sep: str = " OR ", block: int = _BLOCK) -> DataFrame:
    """(group, batch, n_items, query): each group's distinct strings by their UTF-8 bytes, packed in that order under two limits.

    The fold's outcome without the fold: strings are numbered in a written global order and cut into blocks of
    ``block`` rows with the first ``most_items`` of the next. In a block it is known where a batch that begins at
    any row ends, so for each of a block's first rows where a batch may begin, where the first batch of the next block
    begins. Doubling these pointers over the blocks finds every block's first batch in as many steps as the number of blocks
    has binary digits, and blocks make their batches at once. No task holds a group, however large it is.

    A string longer than ``most_chars`` is a ContractError, raised before anything is made. Nulls are left out, a null group is one of its own.
    """
    if not 0 < most_items <= block:
        raise ValueError("most_items must be from 1 to the rows of a block")
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("group"), F.col(value).cast("string").alias("value")).distinct()
    rows = _numbered(rows, ["group", "value"], "n").select("group", "value", "n", F.char_length("value").cast("long").alias("size"), F.xxhash64("group", F.col("group").isNull()).alias("__group"))
    b = F.floor(F.col("n") / block)
    both = F.when((F.col("n") % block < most_items) & (F.col("n") >= block), F.array(b, b - 1)).otherwise(F.array(b))
    rows = written(rows.withColumn("block", F.explode(both)))
    longest = rows.agg(F.max("size"), F.max("block"), F.max_by("value", "size")).first()
    if longest[0] is not None and longest[0] > most_chars:
        raise ContractError(f"longer than a batch: {longest[2][:40]}")
    width = len(sep)

    def pointers(frame: pa.Table) -> pa.Table:
        order, after = _ends(frame, most_items, most_chars, width)
        start = frame["n"].to_numpy()[order[0]]
        inside = min(block, len(order))
        out = after.tolist()
        for i in range(inside - 1, -1, -1):
            if out[i] < inside:
                out[i] = out[out[i]]
        entries = min(most_items, inside)
        return pa.table({"at": pa.array(start + np.arange(entries)), "to": pa.array(start + np.array(out[:entries], np.int64))})

    def batches(key: tuple, frame: pa.Table) -> pa.Table:
        order, after = _ends(frame, most_items, most_chars, width)
        first = frame["n"].to_numpy()[order[0]]
        begins = frame["begins"].drop_null()
        i, made = int(begins[0].as_py() - first), []
        values, groups = frame["value"].take(pa.array(order)).to_pylist(), frame["group"].take(pa.array(order)).to_pylist()
        while i < min(block, len(order)):
            j = int(after[i])
            made.append((groups[i], int(first + i), j - i, sep.join(values[i:j])))
            i = j
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _MADE, strict=True)] if made else [pa.array([], t) for t in _MADE], ["group", "first", "n_items", "query"])

    starts = spark.createDataFrame([(0,)], "at long")
    n_blocks = (longest[1] or 0) + 1
    if n_blocks > 1:
        jump = written(rows.select("block", "n", "size", "__group").groupBy("block").applyInArrow(pointers, "at long, to long"))
        reached = starts
        for step in range((n_blocks - 1).bit_length()):
            reached = written(reached.union(reached.join(jump, "at").select(F.col("to").alias("at"))).distinct())
            if 1 << (step + 1) < n_blocks:
                second = jump.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
                jump = written(jump.join(second, "to").select("at", F.col("beyond").alias("to")))
        starts = reached
    # One start a block: where its first batch begins.
    starts = starts.select(F.floor(F.col("at") / block).alias("block"), F.col("at").alias("begins"))
    made = rows.join(starts.groupBy("block").agg(F.min("begins").alias("begins")), "block").groupBy("block").applyInArrow(batches, "group string, first long, n_items int, query string")
    # Batches of a group are numbered by their order among all, less what came before the group.
    made = written(_numbered(written(made), ["first"], "i"))
    least = made.groupBy("group").agg(F.min("i").alias("least"))
    out = made.alias("m").join(least.alias("l"), F.col("m.group").eqNullSafe(F.col("l.group")))
    return out.select("m.group", (F.col("i") - F.col("least") + 1).cast("int").alias("batch"), "n_items", "query")


_MADE = [pa.string(), pa.int64(), pa.int32(), pa.string()]


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Places from 0 in a global order."""
    return row_numbers(df, order, name).withColumn(name, F.col(name) - 1)


def sorted_unique(df: DataFrame, value: str) -> DataFrame:
    """(n, value): distinct strings that are not null, numbered from 0 by their UTF-8 bytes."""
    return _numbered(df.select(value).where(F.col(value).isNotNull()).distinct(), [value], "n").select("n", value)
