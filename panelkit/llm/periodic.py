"""Periodic runs in texts: stretches of words that repeat themselves three times or more.

A run of period q and length L, q its smallest period, is a longest stretch in which words q apart are
identical; it counts where L >= max(shortest, times * q). Runs are found by recursive frequency splitting. Each
word of such a run occurs ``times`` times in it, so a word that occurs less often in its segment lies in no run,
and splits the segment there; what is left is counted again, segment by segment, until no word is too rare or
little is lost. Segments that survive are scanned by lags. A lag is the distance from a block of k words to the next place
where the block occurs: in a run of period q from k/2 to k that distance is q at each place, and at no other, as two
periods of one stretch as long as their sum have their common divisor as a period too. So one pass over blocks of
1, 2, 4, ... words finds all runs; blocks that occur once in their segment are left out of the next pass.

A document is a row and needs no other, so nothing is shuffled; texts of a slice are counted and scanned
together, as arrays. The work is n log n in a text's words however often it repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import text_slices

#: A segment that loses less than this share of its words in a round is scanned as it is: the scan is exact for
#: any segment, and rounds that gain little could be as many as there are words.
_WORTH = 1 / 64


def segments(codes: np.ndarray, doc: np.ndarray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment of each): the words that frequency splitting leaves; a segment is a stretch of one document."""
    at, seg = np.arange(len(codes)), doc
    words = int(codes.max()) + 1 if len(codes) else 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    n_done = 0
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])]))
        size = np.diff(np.append(first, len(at)))
        seg = np.repeat(np.arange(len(first)), size)
        long = (size >= shortest)[seg]
        at, seg = at[long], seg[long]
        if not len(at):
            break
        _, which, count = np.unique(seg * words + codes[at], return_inverse=True, return_counts=True)
        often = count[which] >= times
        lost = np.bincount(seg[~often], minlength=len(size))
        settled = (lost < _WORTH * size)[seg]
        out = often & settled
        if out.any():
            # Where a settled segment lost words, the stretches between them are segments of their own.
            p, s = at[out], seg[out]
            new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1])])
            done.append((p, n_done + np.cumsum(new)))
            n_done += int(new.sum())
        at, seg = at[often & ~settled], seg[often & ~settled]
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, seg = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(at)
    return at[order], seg[order]


def scan(codes: np.ndarray, at: np.ndarray, seg: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs inside the segments, ordered by start and period."""
    found = []
    block = 1
    rank = np.unique(seg * (int(codes.max()) + 1) + codes[at], return_inverse=True)[1] if len(at) else at
    while len(at):
        order = np.argsort(rank, kind="stable")
        p, r = at[order], rank[order]
        same = r[1:] == r[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[:-1][same]] = (p[1:] - p[:-1])[same]
        hit = np.flatnonzero((lag <= block) & (2 * lag > block))
        if len(hit):
            q, x = lag[hit], at[hit]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1] + 1) | (q[1:] != q[:-1])]))
            last = np.append(first[1:], len(hit)) - 1
            length = x[last] - x[first] + q[first] + block
            rows = np.stack([x[first], length, q[first]], 1)
            found.append(rows[length >= np.maximum(shortest, times * rows[:, 2])])
        again = np.zeros(len(at), bool)
        again[order[:-1][same]] = again[order[1:][same]] = True
        at, rank, seg = at[again], rank[again], seg[again]
        # The block twice as long: this one and the one after it, in one segment.
        then = np.searchsorted(at, at + block)
        then[then == len(at)] = 0
        whole = np.flatnonzero((at[then] == at + block) & (seg[then] == seg)) if len(at) else then
        rank = np.unique(rank[whole] * (int(rank.max()) + 1) + rank[then[whole]], return_inverse=True)[1] if len(whole) else whole
        at, seg = at[whole], seg[whole]
        block *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(docs: list[list[bytes]], shortest: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, (start, length, period), dropped) of lists of words: runs by place in their document, and for each
    word of all documents whether it lies in a run behind that run's first period."""
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    begin = np.concatenate([[0], np.cumsum(n)])
    codes = pa.array(chain.from_iterable(docs), pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), n)
    rows = scan(codes, *segments(codes, doc, shortest, times), shortest, times)
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    of = doc[rows[:, 0]] if len(rows) else np.empty(0, np.int64)
    rows[:, 0] -= begin[of]
    return of, rows, np.cumsum(depth)[:-1] > 0


_RUN = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])


def collapse(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, text) for each row: runs of (start, length, period) by start and period, and the text without them.

    Words are runs of characters other than ASCII blanks. Of each run its first period stays; kept words are joined by
    one blank. Null and empty texts have no runs and an empty text; a null or repeated doc_id is carried as it is, and
    each row is a document of its own; other columns are not read. A text is held whole in one task, as Spark holds it.
    """
    if times < 3:
        raise ValueError("times must be 3 at least: the scan needs a run to hold two blocks a period apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            # bytes.split() divides at exactly the six ASCII blanks.
            docs = [t.encode().split() if t else [] for t in b["text"].to_pylist()]
            of, rows, gone = runs_of(docs, shortest, times)
            has = np.bincount(of, minlength=len(docs))
            texts, begin = [], 0
            for words, n in zip(docs, has.tolist(), strict=True):
                if n:
                    left = np.flatnonzero(~gone[begin : begin + len(words)]).tolist()
                    texts.append(b" ".join([words[i] for i in left]).decode())
                else:
                    texts.append(b" ".join(words).decode())
                begin += len(words)
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has)]), pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(list(map(len, docs)), pa.int64()), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "text"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
