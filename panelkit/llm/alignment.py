"""Alignment of two tokenizers over one corpus, with counts of how many documents link two ids.

Tokens of a document are cut into groups where a token of each side ends at the same byte; each token of a group
is linked with each of the other side. Corpus counts come from an inverted index of pair bitmaps. Documents of
a task are numbered within ranges. In a range every pair of ids has one compressed bitmap of the documents
that link it, the union of those of the slices it was read in, and multiplicity planes: plane j
holds bit j of the number of links less one, so links are counted as the documents plus 2^j times the bits of plane j. Ranges share no document,
so a pair's documents are the sum of its bitmaps' counts, and a pair costs one row a range however often it occurs.

Counts go back along the same postings: each row meets its pair's count and gives it to the documents in its
bitmaps, range by range. What is held in a task is one range, which is closed at a bound of links or documents; the
most linked pair has as many rows as there are ranges, and those are joined and summed in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import cut, kept, text_slices
from panelkit.llm.tokens import Encoder, PieceEncoder

#: A group of more links than this is counted by its distinct ids.
_LARGE = 1 << 12
#: Documents of a range; their numbers fit two bytes.
_MOST_DOCS = 1 << 15


class Vocabulary:
    """The bytes of every id: their number, and where they begin in one string of all."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.first[ids] - ends + n, n) + np.arange(n.sum())].tobytes()


def byte_level(tokenizer: object) -> Vocabulary:
    """Printable Latin-1 characters stand for their byte, those from 256 on for the other bytes in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    n = tokenizer.get_vocab_size()
    # Added tokens have characters of their own; encoded as plain text they do not occur.
    return Vocabulary([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(tokenizer.id_to_token, range(n))])


def pieces(processor: object) -> Vocabulary:
    out = []
    for i in range(processor.get_piece_size()):
        p = processor.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode())
    return Vocabulary(out)


class Aligner:
    """Both encoders and what is known of their ids."""

    def __init__(self, byte_path: str, piece_path: str, most: int = 250_000):
        self.a, self.b = Encoder(byte_path, most, plain=True), PieceEncoder(piece_path, most)
        self.bytes_a, self.bytes_b = byte_level(self.a.tokenizer), pieces(self.b.processor)
        n_a, n_b = len(self.bytes_a.size), len(self.bytes_b.size)
        # A token's text in a digest, with what follows it inside a group and at the end of its side.
        self.names = [f"{i}{s}" for i in range(n_a) for s in ",|"] + [f"{i}{s}" for i in range(n_b) for s in ",;"]
        self.names_b = 2 * n_a

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not a blank and the text."""
        said = [f" {t}" if t else "" for t in texts]
        a, b = self.a(said), self.b(said)
        none = np.empty(0, np.uint32)
        for i, t in enumerate(said):
            raw = t.encode()
            if self.bytes_a.spelled(a[i]) != raw or self.bytes_b.spelled(b[i]) != raw:
                a[i] = b[i] = none
        return a, b


class Slice:
    """Groups and links of some documents."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        self.aligner = aligner
        a, b = aligner.tokens(texts)
        docs = len(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, docs) for x in (a, b))
        self.a, self.b = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b))
        doc = np.repeat(np.arange(docs), self.n_a)
        # Both sides have the same bytes in every document, so they can be laid out one after the other.
        end_a, end_b = np.cumsum(aligner.bytes_a.size[self.a]), np.cumsum(aligner.bytes_b.size[self.b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(common)), np.bincount(self.group_b, minlength=len(common))
        self.to_a, self.to_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        self.doc = doc[self.to_a - 1] if len(common) else np.empty(0, np.int64)
        self.n_groups = np.bincount(self.doc, minlength=docs)
        self.n_links = np.zeros(docs, np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def texts(self) -> list[str]:
        """Each document's groups as a1,a2|b1;a3|b2."""
        names, order = self.aligner.names, np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.zeros(len(self.a), np.int64)
        last_b = np.zeros(len(self.b), np.int64)
        last_a[self.to_a - 1] = last_b[self.to_b - 1] = 1
        order[np.arange(len(self.a)) + (self.to_b - self.in_b)[self.group_a]] = 2 * self.a + last_a
        order[np.arange(len(self.b)) + self.to_a[self.group_b]] = self.aligner.names_b + 2 * self.b + last_b
        out, codes, at = [], order.tolist(), 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join([names[c] for c in codes[at : at + n]])[:-1])
            at += n
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair << 16 | document, links) in order; a pair is a << 16 | b."""
        times = self.in_b[self.group_a]
        large = self.in_a * self.in_b > _LARGE
        times[large[self.group_a]] = 0
        ends = np.cumsum(times)
        a = np.repeat(self.a, times)
        b = self.b[np.repeat((self.to_b - self.in_b)[self.group_a] - ends + times, times) + np.arange(len(a))]
        keys = [(a << 32) + (b << 16) + np.repeat(self.doc[self.group_a], times)]
        counts = [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(large).tolist():
            x, n = np.unique(self.a[self.to_a[g] - self.in_a[g] : self.to_a[g]], return_counts=True)
            y, m = np.unique(self.b[self.to_b[g] - self.in_b[g] : self.to_b[g]], return_counts=True)
            keys.append(((x[:, None] << 32) + (y << 16) + self.doc[g]).ravel())
            counts.append((n[:, None] * m).ravel())
        return summed(np.concatenate(keys), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts' sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def compressed(group: np.ndarray, doc: np.ndarray, groups: int, docs: int) -> pa.LargeBinaryArray:
    """A bitmap of documents for each group, from sorted (group, doc).

    A set of few documents is a list of two-byte numbers, which has an even length; others are a bitmap of the whole range, of an odd length.
    """
    whole = (docs + 7) // 8 | 1
    n = np.bincount(group, minlength=groups)
    few = 2 * n < whole
    size = np.where(few, 2 * n, whole)
    offset = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(offset[-1], np.uint8)
    listed = few[group]
    rank = np.arange(len(group)) - (np.cumsum(n) - n)[group]
    at = (offset[group] + 2 * rank)[listed]
    out[at], out[at + 1] = doc[listed] & 255, doc[listed] >> 8
    np.bitwise_or.at(out, offset[group[~listed]] + (doc[~listed] >> 3), (1 << (doc[~listed] & 7)).astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), groups, [None, pa.py_buffer(offset), pa.py_buffer(out)])


def expanded(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place of the bitmap, document) for every document of every bitmap."""
    bitmaps = bitmaps.cast(pa.large_binary())
    if not len(bitmaps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offset = np.frombuffer(bitmaps.buffers()[1], np.int64)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1]
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)
    size = np.diff(offset)
    few = size % 2 == 0
    n = np.where(few, size // 2, 0)
    group = np.repeat(np.arange(len(size)), n)
    at = np.repeat(offset[:-1] - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(len(group))
    found = [(group, data[at] + (data[at + 1].astype(np.int64) << 8))]
    for g in np.flatnonzero(~few).tolist():
        doc = np.flatnonzero(np.unpackbits(data[offset[g] : offset[g + 1]], bitorder="little"))
        found.append((np.full(len(doc), g), doc))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def postings(keys: np.ndarray, counts: np.ndarray, docs: int) -> pa.RecordBatch:
    """(a, b, n_docs, n_links, docs, planes) of one range, from its links by pair and document."""
    pair, doc = keys >> 16, keys & 0xFFFF
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    pair = pair[first]
    n_docs = np.diff(np.append(first, len(group)))
    more = counts - 1
    top = np.maximum.reduceat(more, first)
    planes = np.where(top > 0, np.frexp(top.astype(np.float64))[1], 0)
    begin = np.concatenate([[0], np.cumsum(planes)])
    bits = [(begin[group[s]] + j, doc[s]) for j in range(int(planes.max())) for s in [np.flatnonzero(more >> j & 1)]]
    in_plane, of = (np.concatenate(x) for x in zip(*bits, strict=True)) if bits else (np.empty(0, np.int64),) * 2
    order = np.argsort(in_plane, kind="stable")
    columns = [
        pa.array((pair >> 16).astype(np.int32)),
        pa.array((pair & 0xFFFF).astype(np.int32)),
        pa.array(n_docs.astype(np.int64)),
        pa.array(np.add.reduceat(counts, first)),
        compressed(group, doc, len(first), docs).cast(pa.binary()),
        pa.ListArray.from_arrays(pa.array(begin, pa.int32()), compressed(in_plane[order], of[order], int(begin[-1]), docs).cast(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "n_docs", "n_links", "docs", "planes"])


_ROW = pa.schema(
    [("range", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string())]
    + [("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))]
)
_ROW_SQL = "range long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, n_docs long, docs binary, planes array<binary>"


def _row(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ROW], schema=_ROW)


def index(df: DataFrame, *, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most_links: int = 1 << 21, fold: Callable[[str], str] | None = None) -> DataFrame:
    """The written index: a row a document (a is null) and a row a pair and range, in one table.

    A range is closed once it has ``most_links`` distinct links, or as many documents as two bytes number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs = 0

        def closed() -> Iterator[pa.RecordBatch]:
            # The union of the slices' bitmaps: their documents differ, so each (pair, document) stays one.
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            if len(keys):
                p = postings(keys, counts, docs)
                yield _row(len(p), range=pa.array(np.full(len(p), number)), **{k: p[k] for k in p.schema.names})

        for big in text_slices(batches):
            for at in range(0, len(big), _MOST_DOCS):
                b = big.slice(at, _MOST_DOCS)
                if held and (docs + len(b) > _MOST_DOCS or sum(len(k) for k, _ in held) >= most_links):
                    yield from closed()
                    number, docs = number + 1, 0
                s = Slice(aligner, b["text"].to_pylist())
                texts = s.texts()
                keys, counts = s.links()
                held.append((keys + docs, counts))
                per_doc = {k: pa.array(getattr(s, k)) for k in ("n_a", "n_b", "n_groups", "n_links")}
                yield _row(len(b), range=pa.array(np.full(len(b), number)), doc=pa.array(np.arange(docs, docs + len(b)), pa.int32()), doc_id=b["id"], groups=pa.array([fold(t) for t in texts] if fold else texts, pa.string()), **per_doc)
                docs += len(b)
        if held:
            yield from closed()

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return cut(docs.mapInArrow(run, _ROW_SQL))


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) of an index: in how many documents the pair is linked, how often, and whether no pair of its a is in more."""
    counts = cut(made.where("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links")))
    # At most a row for each id of the vocabulary.
    top = F.broadcast(counts.groupBy("a").agg(F.max("n_docs").alias("top")))
    return counts.join(top, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def _returned(rows: pa.Table) -> pa.Table:
    """What the postings of one range bring to its documents."""
    rows = rows.combine_chunks()
    count, best = rows["count"].to_numpy(), rows["best"].to_numpy()
    sums = np.zeros((_MOST_DOCS, 2), np.int64)

    def add(bitmaps: pa.Array, row: np.ndarray, weight: np.ndarray) -> None:
        which, doc = expanded(bitmaps)
        r, w = row[which], weight[which]
        np.add.at(sums[:, 0], doc, w * best[r])
        np.add.at(sums[:, 1], doc, w * count[r])

    every = np.arange(len(rows))
    add(rows["docs"].chunk(0), every, np.ones(len(rows), np.int64))
    planes = rows["planes"].chunk(0)
    n = planes.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(every, n)
    add(planes.flatten(), row, 1 << (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)))
    doc = np.flatnonzero(sums[:, 1])
    return pa.table({"range": pa.array(np.full(len(doc), rows["range"][0].as_py())), "doc": pa.array(doc, pa.int32()), "n_best": sums[doc, 0], "count_sum": sums[doc, 1]})


def align(df: DataFrame, *, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most_links: int = 1 << 21, fold: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of ``df``.

    n_best counts the links of pairs that are in as many documents as any pair of their a, count_sum adds up how many
    documents each link's pair is in. groups lists the ids as a1,a2|b1;a3|b2, or is what ``fold`` makes of that. Null and empty texts, and texts that a side does
    not spell exactly, have no tokens: zeros, and groups of an empty text. Rows are documents of their own, also where ids are repeated or null; other columns are not read.
    An empty table gives an empty frame.
    """
    made = index(df, byte_path=byte_path, piece_path=piece_path, id_col=id_col, text_col=text_col, most_links=most_links, fold=fold)
    scores = pair_counts(made).select("a", "b", F.col("n_docs").alias("count"), F.col("best").cast("long").alias("best"))
    scored = made.where("a is not null").select("range", "a", "b", "docs", "planes").join(scores, ["a", "b"]).select("range", "docs", "planes", "count", "best")
    sums = scored.groupBy("range").applyInArrow(_returned, "range long, doc int, n_best long, count_sum long")
    docs = made.where("a is null").select("range", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return docs.join(sums, ["range", "doc"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_best", "count_sum")], "groups")
