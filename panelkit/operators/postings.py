"""Postings of n-grams in compressed blocks, and sums over pairs of documents made where the postings of a term meet.

A posting as a row has a header and eight bytes a column; sorted by term in a block of many documents, most of that compresses away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Kinds of postings: documents without one before them, counted by period; documents; documents before.
_COUNTED, _NOW, _BEFORE = 0, 1, 2
#: Postings and documents of a block's batch. Fixed values; places of documents are held in 16 bits.
_BATCH, _ROWS = 1 << 20, 1 << 15
#: Odd, so that no two terms are mixed to the same; the upper bits of the product tell a term's bucket.
_MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "bucket int, size int, block binary"
SUMS = "__doc long, dot double, now double, before double"
_SUMS = ["__doc", "dot", "now", "before"]


def terms(text: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts), an n-gram of up to four UTF-16 units as one integer, mixed and in order."""
    units = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.uint64)
    grams, found = units, [units] if low == 1 else []
    for n in range(2, high + 1):
        grams = (grams[: max(len(units) - n + 1, 0)] << np.uint64(16)) | units[n - 1 :]
        found += [grams] if n >= low else []
    return np.unique(np.concatenate(found) * _MIX, return_counts=True)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences that wrap; a running sum of the same width undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


_LAYOUT = (("term", np.uint64, 0, True), ("kinds", np.uint8, 1, False), ("row", np.uint16, 2, True), ("c", np.uint32, 2, False), ("doc", np.int64, 3, True), ("rank", np.int32, 3, False), ("n", np.int64, 3, True))


def _packed(parts: dict[str, np.ndarray]) -> tuple[int, bytes]:
    head = np.array([len(parts[k]) for k in ("term", "kinds", "row", "doc")], np.int64)
    raw = head.tobytes() + b"".join(_planes(_steps(parts[k].astype(t)) if steps else parts[k].astype(t)) for k, t, _, steps in _LAYOUT)
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(size: int, block: bytes) -> dict[str, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, decompressed_size=size), np.uint8)
    head, at, out = raw[:32].view(np.int64), 32, {}
    for k, t, length, steps in _LAYOUT:
        width, n = np.dtype(t).itemsize, int(head[length])
        x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(t).reshape(-1)
        out[k], at = np.cumsum(x, dtype=t) if steps else x, at + n * width
    return out


def blocks(low: int, high: int, buckets: int):
    """From batches of (__doc, __t, __u, __rank, __n) to BLOCKS: a document's text, the one before it or null, and its period's place and N.

    A document with one before it has its own postings and that one's; one without is only counted, by term and period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {_COUNTED: [], _NOW: [], _BEFORE: []}
        docs: list[tuple[int, int, int]] = []
        places: dict[int, int] = {}
        total = 0
        for b in batches:
            for doc, t, u, rank, n in zip(*(b[k].to_pylist() for k in ("__doc", "__t", "__u", "__rank", "__n")), strict=True):
                term, c = terms(t, low, high)
                if u is None:
                    if rank not in places:
                        places[rank] = len(docs)
                        docs.append((-1, rank, n))
                    held[_COUNTED].append((term, np.ones(len(term), np.uint32), places[rank]))
                else:
                    held[_NOW].append((term, c, len(docs)))
                    before = terms(u, low, high)
                    held[_BEFORE].append((*before, len(docs)))
                    total += len(before[0])
                    docs.append((doc, rank, n))
                total += len(term)
                if total >= _BATCH or len(docs) >= _ROWS:
                    if total:
                        yield _blocks_of(held, docs, buckets)
                    held, docs, places, total = {k: [] for k in held}, [], {}, 0
        if total:
            yield _blocks_of(held, docs, buckets)

    return run


def _blocks_of(held: dict[int, list], docs: list[tuple[int, int, int]], buckets: int) -> pa.RecordBatch:
    """The blocks of one batch, one a bucket that has any of its terms; counts of the same term and period are added up."""
    lists = [(k, x) for k in (_COUNTED, _NOW, _BEFORE) for x in sorted(held[k], key=lambda x: x[2])]
    term = np.concatenate([x[0] for _, x in lists])
    c = np.concatenate([x[1] for _, x in lists]).astype(np.uint32)
    lengths = [len(x[0]) for _, x in lists]
    kind = np.repeat(np.array([k for k, _ in lists], np.uint8), lengths)
    row = np.repeat(np.array([x[2] for _, x in lists], np.uint16), lengths)
    order = np.argsort(term, kind="stable")  # inside a term by kind and document
    term, c, kind, row = term[order], c[order], kind[order], row[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])))
    term, c, kind, row = term[first], np.add.reduceat(c, first), kind[first], row[first]
    bucket = ((term >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(term)]
    doc, rank, n = (np.array(x) for x in zip(*docs, strict=True))
    made = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        starts = np.append(True, term[i + 1 : j] != term[i : j - 1])
        used, at = np.unique(row[i:j], return_inverse=True)
        # A posting's kind, and whether it is its term's first.
        parts = {"term": term[i:j][starts], "kinds": kind[i:j] | (starts.astype(np.uint8) << 2), "row": at, "c": c[i:j], "doc": doc[used], "rank": rank[used], "n": n[used]}
        made.append((int(bucket[i]), *_packed(parts)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "size", "block"])


def _added(term: np.ndarray, rank: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((rank, term))
    term, rank, k = term[order], rank[order], k[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (rank[1:] != rank[:-1]))) if len(term) else np.array([], np.int64)
    return term[first], rank[first], np.add.reduceat(k, first) if len(first) else k


class _Frequencies:
    """In how many documents of a bucket's blocks a term is, up to a period."""

    def __init__(self, held: list[tuple[int, bytes]]) -> None:
        parts: list[tuple] = []
        for x in held:
            b = _unpacked(*x)
            kind = b["kinds"] & 3
            counts = kind != _BEFORE
            term = b["term"][np.cumsum(b["kinds"] >> 2, dtype=np.int64) - 1]
            parts.append(_added(term[counts], b["rank"][b["row"][counts]], np.where(kind[counts] == _COUNTED, b["c"][counts], 1).astype(np.int64)))
            if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > max(len(parts[0][0]), 1 << 20):
                parts = [_added(*map(np.concatenate, zip(*parts, strict=True)))]
        term, rank, k = _added(*map(np.concatenate, zip(*parts, strict=True)))
        starts = np.append(True, term[1:] != term[:-1]) if len(term) else np.array([], bool)
        self.terms, self.first = term[starts], np.flatnonzero(starts)
        self.width = int(rank.max(initial=0)) + 1
        self.keys = (np.cumsum(starts, dtype=np.int64) - 1) * self.width + rank
        self.upto = np.append(0, np.cumsum(k))

    def of(self, term: np.ndarray, each: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Frequencies of the terms ``term[each]`` as of ``rank``; each of ``term`` is known or counts 0."""
        if not len(self.terms):
            return np.zeros(len(each), np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = (self.terms[at] == term)[each]
        at = at[each]
        upto = self.upto[np.searchsorted(self.keys, at * self.width + np.minimum(rank, self.width - 1), "right")]
        return np.where(known, np.maximum(upto - self.upto[self.first[at]], 0), 0)


def _sums_of(held: list[tuple[int, bytes]], min_df: int) -> Iterator[pa.RecordBatch]:
    """A bucket's part of every pair's product and squared norms."""
    known = _Frequencies(held)
    for x in held:
        b = _unpacked(*x)
        size = len(b["doc"])
        kind, each = b["kinds"] & 3, np.cumsum(b["kinds"] >> 2, dtype=np.int64) - 1
        sides = []
        for k in (_NOW, _BEFORE):
            mine = np.flatnonzero(kind == k)
            row, t = b["row"][mine], each[mine]
            df = known.of(b["term"], t, b["rank"][row])
            w = (1 + np.log(b["c"][mine])) * (np.log((1 + b["n"][row]) / (1 + df)) + 1)
            kept = df >= min_df
            sides.append((t[kept] * size + row[kept], row[kept], w[kept]))
        (a, row, w), (z, other, v) = sides
        _, i, j = np.intersect1d(a, z, assume_unique=True, return_indices=True)
        # Of no rows, bincount makes integers.
        dot, now, before = (np.bincount(at, x, size).astype(np.float64) for at, x in ((row[i], w[i] * v[j]), (row, w * w), (other, v * v)))
        found = np.flatnonzero((now > 0) | (before > 0))
        yield pa.RecordBatch.from_arrays([pa.array(y[found]) for y in (b["doc"], dot, now, before)], _SUMS)


def sums(min_df: int):
    """From BLOCKS, a bucket's together, to SUMS: a row a pair and block, to be added up. A bucket's blocks are held compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        current = None
        for b in batches:
            for bucket, size, block in zip(*(b[k].to_pylist() for k in ("bucket", "size", "block")), strict=True):
                if bucket != current and held:
                    yield from _sums_of(held, min_df)
                    held = []
                current = bucket
                held.append((size, block))
        if held:
            yield from _sums_of(held, min_df)

    return run
