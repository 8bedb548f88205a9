"""Token-id files of directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into chunks of ``CHUNK`` bits, lowest
first. Level 0 has a chunk for every id; a set bit in a level's continuation bitmap says that the id goes on
in the next level, at the place that the number of set bits before it gives. A rank directory holds that
number for every ``RANK_EVERY`` bits, so that any id is read from a few words without decoding a block.

A file image is little-endian:

    magic "DAC1" | u32 levels | u64 ids | u64 documents | document ends as u64 ...
    and for each level: u64 entries | entries chunks as u8 | bitmap as u64 words | rank directory as u64 words

The images are the rows of a table that Spark writes and reads, in any store that it reaches: columns part and
piece give their order, n_ids and n_docs their sizes, before the ids of a part's earlier pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.shared import text_slices
from panelkit.llm.tokens import encoder

CHUNK = 8
RANK_EVERY = 512
_MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sIQQ")


def encode(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file image of documents' ids: ``ends`` holds where each document ends among all ids."""
    level = ids.astype(np.uint64)
    parts: list[bytes] = []
    levels = 0
    while len(level) or not levels:
        goes_on = level >= (1 << CHUNK)
        bits = np.zeros(-(-(len(level) + 1) // 64) * 64, np.uint8)
        bits[: len(level)] = goes_on
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(goes_on)])
        rank = before[np.arange(0, len(level) + 1, RANK_EVERY)].astype(np.uint64)
        parts += [struct.pack("<Q", len(level)), (level & np.uint64((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), words.tobytes(), rank.tobytes()]
        level = level[goes_on] >> np.uint64(CHUNK)
        levels += 1
    return _HEAD.pack(_MAGIC, levels, len(ids), len(ends)) + ends.astype("<u8").tobytes() + b"".join(parts)


class Image:
    """A reader of one file image."""

    def __init__(self, image: bytes):
        magic, levels, self.n_ids, n_docs = _HEAD.unpack_from(image)
        if magic != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = _HEAD.size
        self.ends = np.frombuffer(image, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            at += 8 + n
            words = np.frombuffer(image, np.uint8, -(-(n + 1) // 64) * 8, at)
            at += len(words)
            rank = np.frombuffer(image, "<u8", n // RANK_EVERY + 1, at)
            at += 8 * len(rank)
            self.levels.append((chunks, words, rank))

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``, by one step a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, words, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not words[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            bits = np.unpackbits(words[block * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")
            i = int(rank[block]) + int(bits[: i - block * RANK_EVERY].sum())
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        value = np.zeros(0, np.uint32)
        for chunks, words, _ in reversed(self.levels):
            goes_on = np.unpackbits(words, bitorder="little")[: len(chunks)].astype(bool)
            above = np.zeros(len(chunks), np.uint32)
            above[goes_on] = value
            value = (above << np.uint32(CHUNK)) | chunks
        return value

    def document(self, k: int) -> np.ndarray:
        first = int(self.ends[k - 1]) if k else 0
        return np.fromiter((self[i] for i in range(first, int(self.ends[k]))), np.uint32)


def write(df: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 20) -> None:
    """Encode every whole text, append ``end_id`` to each, and write segments in ascending id order to ``path``.

    The order is that of a range partitioning on the id: part is a partition's number and piece a segment's
    inside it. A document is never split; one longer than ``segment_ids`` has a segment of its own. Null and
    empty texts have the end id alone. Null ids come first; rows that share an id are
    ordered by a hash of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        of = encoder(tokenizer)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        n = before = 0

        def image() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            row = {"part": part, "piece": piece, "n_ids": n, "before": before, "n_docs": len(held), "doc_ids": docs, "image": encode(np.concatenate(held), ends)}
            return pa.RecordBatch.from_pylist([row], _SEGMENT)

        end = np.array([end_id], np.uint32)
        for b in text_slices(batches):
            for doc, ids in zip(b["id"].to_pylist(), of(b["text"].to_pylist()), strict=True):
                if held and n + len(ids) + 1 > segment_ids:
                    yield image()
                    docs, held, n, piece, before = [], [], 0, piece + 1, before + n
                docs.append(doc)
                held.append(np.append(ids, end))
                n += len(ids) + 1
        if held:
            yield image()

    spark = df.sparkSession
    order = ["id", "hash", "at"]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("text"))
    # Boundaries are sampled from three numbers a row, never from texts; the last divides equal rows.
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    segments = rows.select("id", "text").mapInArrow(run, "part int, piece int, n_ids long, before long, n_docs long, doc_ids array<long>, image binary")
    segments.write.option("compression", "none").parquet(path)


_SEGMENT = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("n_ids", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())])


def read(df: DataFrame) -> DataFrame:
    """The segments of ``df``, a reader of a written path, with ``start``: the ids in all segments before."""
    by_part = df.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row a partition of the writing job: the window's single task and the broadcast are as small as that
    # job's task list. Segments know what is before them in their partition, so images are not shuffled.
    parts = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__parts"))
    return df.join(F.broadcast(parts), "part").withColumn("start", F.col("__parts") + F.col("before")).drop("__parts")


def decoded(segments: DataFrame, fold, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows that ``fold(doc_id, start, ids)`` makes of each document in ``segments``, read from the images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_ids, start, image in zip(b["doc_ids"], b["start"], b["image"], strict=True):
                x = Image(image)
                ids, first = x.all(), 0
                rows = []
                for doc, end in zip(doc_ids, x.ends.tolist(), strict=True):
                    rows.append(fold(None if doc is None or doc != doc else int(doc), int(start) + first, ids[first:end]))
                    first = end
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return segments.select("doc_ids", "start", "image").mapInPandas(run, schema)


def token_at(segments: DataFrame, position: int) -> int:
    """The id at a place of the whole corpus: one segment is read, and one id in it, without decoding the rest."""
    row = segments.where((F.col("start") <= position) & (F.col("start") + F.col("n_ids") > position)).select("start", "image").first()
    if row is None:
        raise IndexError(position)
    return Image(bytes(row["image"]))[position - row["start"]]
