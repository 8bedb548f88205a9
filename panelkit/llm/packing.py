"""Packing of tokenised documents into sequences by bulk-synchronous best fit.

Pieces longer than half a sequence open one each. The others are placed in rounds over two tables, ranked
pieces and open gaps. Pieces are range-sorted once on (length, id), which gives each a rank among those of
its length without any task holding a whole length. A round sweeps both sides on one size axis, from the
largest size down: a gap met on the way is pushed, a piece takes the gap pushed last, the smallest that
holds it. The sweep decides over counts by size, at most one row for each of ``capacity`` sizes whatever
the input; the rows themselves are matched where they lie. Pieces that compete for gaps of one size are
resolved by rank: the k-th piece takes the k-th gap. Every gap then shrinks by what it took, gets its rank
in its new size from the same counts, without a shuffle, and the next round begins.

Where no gap holds a waiting piece, new sequences open, as many as are sure to be needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.shared import cut, partitions, text_slices
from panelkit.llm.tokens import encoder


def pieces(df: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", fold: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, id_bytes, folded): each document's ids with ``end_id`` after them, cut only where longer than ``capacity``.

    ids are little-endian unsigned integers of id_bytes bytes, 2 where the vocabulary allows it and else 4;
    folded is what ``fold`` makes of a piece's ids, null without one. All pieces but the first are then
    ``capacity`` long. Null and empty texts have the end id alone. Rows that repeat a doc_id are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        kind = np.dtype("<u2" if max(of.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        for b in text_slices(batches):
            rows = []
            for doc, ids in zip(b["id"].to_pylist(), of(b["text"].to_pylist()), strict=True):
                ids = np.append(ids, end)
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, k, s, e - s, ids[s:e].astype(kind).tobytes(), kind.itemsize, fold(ids[s:e]) if fold else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE, strict=True)], _PIECE_NAMES)

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, id_bytes int, folded long")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids", "id_bytes", "folded"]
_PIECE = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ranks from 0 within equal values of ``by[0]``, ordered by all of ``by``, in column ``name``.

    A range partitioning on all of ``by`` splits a value that a third of all rows share over several
    partitions; each ranks its own rows and adds the counts of the partitions before, of which there is one
    row for each value and partition.
    """
    n = partitions(df.sparkSession)
    rows = df.repartitionByRange(n, *by).withColumn("__p", F.spark_partition_id())
    rows = cut(rows)
    counts = rows.groupBy(by[0], "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by[0]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by[0], "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(by[0], "__p").orderBy(*by[1:])) - 1
    return rows.withColumn("__own", own).join(counts, [by[0], "__p"]).withColumn(name, F.col("__before") + F.col("__own")).drop("__p", "__own", "__before")


def sweep(waiting: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(gap size, first gap rank, gaps, piece size, first piece rank, pieces a gap): the best fit of counts by size.

    From the largest size down: gaps are pushed, pieces take from the gap size pushed last. Where more
    pieces of a size wait than gaps of the fitting size are left, each gap takes several, as best fit would.
    """
    plan = []
    stack: list[list[int]] = []  # gap size, next rank, gaps left
    for size in sorted(set(waiting) | set(gaps), reverse=True):
        if size in gaps:
            stack.append([size, 0, gaps[size]])
        left, rank = waiting.get(size, 0), 0
        while left and stack:
            free, first, n = stack[-1]
            times = min(free // size, max(1, left // n))
            take = min(n, left // times)
            plan.append((free, first, take, size, rank, times))
            left, rank = left - take * times, rank + take * times
            stack[-1][1:] = [first + take, n - take]
            if take == n:
                stack.pop()
    return plan


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` of (item, length): lengths from 1 to ``capacity``, items distinct.

    Sequences are filled from the left without holes. An empty frame packs into none.
    """
    spark = items.sparkSession
    ranked = cut(numbered(items.select("item", F.col("length").cast("long").alias("length")), ["length", "item"], "rank"))
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}  # at most ``capacity`` rows, as below
    opening = sorted((k for k in counts if 2 * k > capacity), reverse=True)
    base, holes, n_sequences = [], {}, 0
    for k in opening:
        base.append((k, n_sequences))
        n = counts.pop(k)
        n_sequences += n
        if k < capacity:
            holes[capacity - k] = n
    base = F.broadcast(spark.createDataFrame(base, "length long, base long"))
    alone = ranked.join(base, "length").select("item", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "length", "rank")
    gaps = alone.select("sequence_id", (capacity - F.col("length")).alias("free"), F.col("rank").alias("gap_rank")).where("free > 0")
    used = dict.fromkeys(counts, 0)
    rounds: list[DataFrame] = []
    while counts:
        largest = max(holes, default=0)
        if max(counts) > largest:
            # As many new sequences as must come: for the pieces that no gap holds, or for what exceeds all gaps.
            unfit = sum(k * n for k, n in counts.items() if k > largest)
            excess = sum(k * n for k, n in counts.items()) - sum(k * n for k, n in holes.items())
            new = -(-max(unfit, excess) // capacity)
            fresh = spark.range(new).select((F.col("id") + n_sequences).alias("sequence_id"), F.lit(capacity).cast("long").alias("free"), F.col("id").alias("gap_rank"))
            gaps, n_sequences = gaps.union(fresh), n_sequences + new
            holes[capacity] = new
        steps, counts, holes = _steps(sweep(counts, holes), counts, holes, used)
        steps = F.broadcast(spark.createDataFrame(steps, "free long, lo long, hi long, size long, first long, times long, to long"))
        at = F.col("gap_rank") - F.col("lo")
        done = gaps.join(steps, "free").where("gap_rank >= lo and gap_rank < hi")
        done = cut(
            done.select(
                "sequence_id",
                F.col("size").alias("length"),
                (F.col("first") + at * F.col("times")).alias("rank"),
                "times",
                (capacity - F.col("free")).alias("offset"),
                (F.col("free") - F.col("size") * F.col("times")).alias("free"),
                (F.col("to") + at).alias("gap_rank"),
            )
        )
        rounds.append(done.where("times > 0"))
        gaps = done.select("sequence_id", "free", "gap_rank").where("free > 0")
    out = alone.select("item", "sequence_id", "offset")
    if rounds:
        taken = rounds[0]
        for r in rounds[1:]:
            taken = taken.union(r)
        taken = taken.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("i"))
        taken = taken.select("sequence_id", "length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("offset") + F.col("i") * F.col("length")).alias("offset"))
        out = out.union(ranked.join(taken, ["length", "rank"]).select("item", "sequence_id", "offset"))
    return out


def _steps(plan: list[tuple], counts: dict[int, int], holes: dict[int, int], used: dict[int, int]) -> tuple[list[tuple], dict[int, int], dict[int, int]]:
    """What becomes of every range of gap ranks in a round, and the counts after it.

    (gap size, first rank, end of ranks, piece size, first piece rank, pieces a gap, new first rank): gaps
    that take nothing stand there with 0 pieces. Ranks in the new size follow the order of the ranges.
    """
    by_gap: dict[int, list[tuple]] = {}
    for free, first, n, size, rank, times in plan:
        by_gap.setdefault(free, []).append((first, first + n, size, used[size] + rank, times))
    left = dict(counts)
    for _, _, n, size, _, times in plan:
        left[size] -= n * times
    for size in counts:
        used[size] += counts[size] - left[size]
    after: dict[int, int] = {}
    steps = []
    for free in sorted(holes):
        ranges = sorted(by_gap.get(free, []))
        end = ranges[-1][1] if ranges else 0
        if end < holes[free]:
            ranges.append((end, holes[free], 0, 0, 0))
        for lo, hi, size, first, times in ranges:
            new = free - size * times
            steps.append((free, lo, hi, size, first, times, after.get(new, 0)))
            after[new] = after.get(new, 0) + hi - lo
    after.pop(0, None)
    return steps, {k: n for k, n in left.items() if n}, after


def pack(df: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", fold: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, id_bytes, sequence_id, offset) for every piece of every row of ``df``.

    ids are the piece's token ids as little-endian unsigned integers of id_bytes bytes; offset is its place
    in the sequence, without holes from 0. With ``fold`` a column folded, what it makes of the ids, stands in
    place of ids and id_bytes, which are then written with the pieces but not shuffled. An empty table gives an
    empty frame; null texts hold their end id alone; columns other than the two named are not read.
    """
    made = pieces(df, tokenizer=tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col, fold=fold)
    made = cut(made.withColumn("item", F.monotonically_increasing_id()))
    where = best_fit(made.select("item", "length"), capacity)
    return made.drop("folded" if fold is None else "ids", *([] if fold is None else ["id_bytes"])).join(where, "item").drop("item")
