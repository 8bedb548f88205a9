"""Packing of tokenised documents by first-fit decreasing in randomised groups.

Documents are dealt out by a random draw, so that each group is a fair sample of all lengths whatever order
the input has, and groups are packed without knowledge of each other: one shuffle of token ids, and no step that sees
more than a group. In a group pieces are placed from the longest down, each in the first sequence with room for
it. A tournament tree over the sequences' rooms finds that one: an inner node holds the larger room of its two
children, so the way down to the first sequence that is large enough takes a step a level.

Documents may be cut anywhere. What is longer than a sequence fills whole ones first; when all pieces are
placed, the last sequences are dissolved into the gaps of the earlier ones, cutting a piece only where no gap
holds it. A group is left with one sequence that is not full, and that is cut at powers of two, lengths which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import partitions, text_slices
from panelkit.llm.tokens import word_encoder


class Tournament:
    """Rooms of sequences in a tree whose inner nodes hold the larger of their two children."""

    def __init__(self, rooms: list[int]):
        self.leaves = 1 << max(0, (len(rooms) - 1).bit_length())
        self.best = [0] * self.leaves + rooms + [0] * (self.leaves - len(rooms))
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def first(self, need: int) -> int:
        """The first sequence with ``need`` room or more, else -1."""
        best = self.best
        if best[1] < need:
            return -1
        i = 1
        while i < self.leaves:
            i = 2 * i if best[2 * i] >= need else 2 * i + 1
        return i - self.leaves

    def room(self, k: int) -> int:
        return self.best[self.leaves + k]

    def most(self) -> int:
        return self.best[1]

    def set(self, k: int, room: int) -> None:
        best, i = self.best, self.leaves + k
        best[i] = room
        while i > 1:
            i //= 2
            larger = max(best[2 * i], best[2 * i + 1])
            if best[i] == larger:
                break
            best[i] = larger


#: A piece: the number of its document, its first token there, its length.
Piece = tuple[int, int, int]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences of pieces for documents of the given lengths, by the rules of the module."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        full += [[(doc, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda p: (-p[2], p[0]))
    # First fit leaves at most one sequence no more than half full.
    bound = min(len(rest), 2 * sum(p[2] for p in rest) // capacity + 1)
    tree = Tournament([capacity] * bound)
    made: list[list[Piece]] = []
    for piece in rest:
        k = tree.first(piece[2])
        if k == len(made):
            made.append([])
        made[k].append(piece)
        tree.set(k, tree.room(k) - piece[2])
    return full + _closed(made, capacity)


def _closed(made: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The same pieces with all sequences full but those of the last one, whose lengths are powers of two."""
    tree = Tournament([capacity - sum(p[2] for p in s) for s in made] or [0])
    left: list[Piece] = []
    while made and not left:
        if tree.most() == 0:
            return made
        tree.set(len(made) - 1, 0)
        for doc, s, n in made.pop():
            while n and tree.most():
                k = tree.first(n)
                if k < 0:
                    k = tree.first(tree.most())
                m = min(n, tree.room(k))
                made[k].append((doc, s, m))
                tree.set(k, tree.room(k) - m)
                s, n = s + m, n - m
            if n:
                left.append((doc, s, n))
    return made + at_powers(left)


def at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in sequences whose lengths are the powers of two in their sum, the largest first."""
    total = sum(p[2] for p in pieces)
    out: list[list[Piece]] = []
    waiting = pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & 1 << bit
        if not need:
            continue
        out.append([])
        while need:
            doc, s, n = waiting.pop()
            m = min(n, need)
            out[-1].append((doc, s, m))
            need -= m
            if m < n:
                waiting.append((doc, s + m, n - m))
    return out


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32()), ("folded", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(df: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_tokens: int = 1 << 21, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", fold: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, start, length, ids, id_bytes, doc_tokens, sequence_id, offset) for every piece of every row of ``df``.

    A document is its token ids with ``end_id`` after them; a piece is ``length`` of them from ``start`` on, as
    little-endian unsigned integers of id_bytes bytes, at ``offset`` in its sequence, without holes from 0. With
    ``fold`` a column folded, what it makes of the ids, stands in place of ids and id_bytes. A group has about ``group_tokens``
    tokens, or is one longer document. Every row is a document of its own, whatever its id: repeated
    ids and rows are not joined, null ids stay null, null and empty texts have the end id alone. An empty table packs into none. Columns
    other than the two named are not read. The draw that deals documents out is by a row's place in its partition,
    which a repeated task must find again, as it does in files.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        kind = np.dtype("<u2" if max(of.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        for b in text_slices(batches):
            ids = [np.append(x, end).astype(kind).tobytes() for x in of(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids, pa.binary()), pa.array([kind.itemsize] * len(ids), pa.int32())], ["doc_id", "ids", "id_bytes"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = TaskContext.get().partitionId() << 32
        docs: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def group() -> pa.RecordBatch:
            nonlocal opened
            rows = []
            for pieces in first_fit_decreasing([len(ids) for _, ids in docs], capacity):
                offset = 0
                for k, s, n in pieces:
                    doc, ids = docs[k]
                    part = ids[s : s + n]
                    rows.append((doc, s, n, None if fold else part.tobytes(), None if fold else part.itemsize, fold(part) if fold else None, len(ids), opened, offset))
                    offset += n
                opened += 1
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

        for b in batches:
            for doc, ids, width in zip(b["doc_id"].to_pylist(), b["ids"], b["id_bytes"].to_pylist(), strict=True):
                docs.append((doc, np.frombuffer(ids.as_buffer(), f"<u{width}")))
                tokens += len(docs[-1][1])
                if tokens >= group_tokens:
                    yield group()
                    tokens = 0
        if docs:
            yield group()

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = docs.mapInArrow(encoded, "doc_id long, ids binary, id_bytes int")
    dealt = made.withColumn("draw", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).repartition(partitions(df.sparkSession), "draw").sortWithinPartitions("draw")
    out = dealt.mapInArrow(packed, "doc_id long, start long, length long, ids binary, id_bytes int, folded long, doc_tokens long, sequence_id long, offset long")
    return out.drop(*(["ids", "id_bytes"] if fold else ["folded"]))
