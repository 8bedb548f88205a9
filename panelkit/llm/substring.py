"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash among the runs
of ``run`` words inside it. Consecutive windows with the same minimiser form a super-k-mer and travel as
one packed string to the minimiser's bucket, so that equal windows, which have equal minimisers, meet.

1. A first pass over all documents counts minimisers, combined within tasks. Those that would fill more
   than a share of a bucket are hot; there can be only as many of them as there are buckets times that
   share's inverse, whatever the input, which bounds what is broadcast.
2. A second pass packs. Of equal super-k-mers in one block of documents only the earliest travels: every
   window of the others also starts earlier, so they are marked at once. Windows of hot minimisers
   travel one by one, equal ones again combined within the block, in buckets that their own words name:
   a line in a third of all documents reaches its bucket once a block.
3. A bucket sorts the windows by hash, compares the words of those with equal hashes, and marks every
   window that isn't the earliest of its words.
4. Marked spans meet their document, and the words that no span covers are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelkit.llm.minhash import mix
from panelkit.llm.shared import WORD, cut, kept, partitions, text_slices

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_MARKS = "id long, start long, stop long"
_WORD = re.compile(WORD)


class Block:
    """The words of a block of texts, one after the other, as Arrow and numpy arrays."""

    def __init__(self, texts: pa.Array):
        import xxhash

        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        parent, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
        some = pc.greater(pc.binary_length(words), 0)
        words, parent = words.filter(some), parent.filter(some)
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        self.doc = parent.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.cast(pa.large_binary())
        self.bytes = int(pc.sum(pc.binary_length(words)).as_py() or 0)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        self.hash = own[self.code] if len(own) else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # of each document's words

    def packed(self) -> tuple[bytes, np.ndarray]:
        """All words, each with a blank after it, and where each begins."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(self.code)], self.words.take(pa.array(self.code))), pa.scalar(b" ", pa.large_binary()))
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False)[self.code].astype(np.int64) + 1
        return (joined[0].as_py() or b"") + b" ", np.concatenate([[0], np.cumsum(size)])


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def hash_runs(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each ``length`` neighbours of word hashes."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = out * _MULTIPLIER + h[i : i + len(out)]
    return mix(out)


def super_kmers(b: Block, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer; windows are named by their first word."""
    n = len(b.doc) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = _running_min(hash_runs(b.hash, run), window - run + 1)
    at = np.flatnonzero(b.doc[:n] == b.doc[window - 1 :])  # windows inside one document
    if not len(at):
        return np.empty(0, np.uint64), at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (b.doc[at[1:]] != b.doc[at[:-1]])
    begin = np.flatnonzero(new)
    return least[at[begin]], at[begin], np.diff(np.append(begin, len(at)))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, Block]]:
    """Blocks of about ``most`` bytes of text, each in the order of ids."""
    held, size = [], 0

    def made() -> tuple[np.ndarray, Block]:
        t = pa.Table.from_batches(held).combine_chunks().sort_by("id").combine_chunks()
        return t["id"].to_numpy(), Block(t["text"].chunk(0) if t["text"].num_chunks else pa.array([], pa.string()))

    for b in batches:
        # A batch may be many times a block.
        bytes_ = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = int(bytes_[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(bytes_, before + most - size, "right")))
            held.append(b.slice(at, end - at))
            size += int(bytes_[end - 1]) - before
            at = end
            if size >= most or at < b.num_rows:
                yield made()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield made()


def minimiser_counts(docs: DataFrame, window: int, run: int, block_bytes: int) -> DataFrame:
    """(minimiser, n): how many super-k-mers have it; those met once in a block are left out of its count.

    A null minimiser's n is the bytes of all super-k-mers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("none",), dict)
        for _, b in _blocks(batches, block_bytes):
            minimisers, _, windows = super_kmers(b, window, run)
            value, n = np.unique(minimisers, return_counts=True)
            some = n > 1
            a_word = b.bytes / max(1, len(b.doc)) + 1
            size = int(a_word * (windows.sum() + (window - 1) * len(windows)))
            yield pa.RecordBatch.from_arrays([pa.array([None, *value[some].view(np.int64).tolist()], pa.int64()), pa.array([size, *n[some].tolist()], pa.int64())], ["minimiser", "n"])

    return docs.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))


def _pack(docs: DataFrame, hot: np.ndarray, buckets: int, window: int, run: int, block_bytes: int) -> DataFrame:
    """(bucket, payload, id, start, stop): a payload of packed strings for each block and bucket, and marked spans.

    A payload is one compressed string: for each super-k-mer its id, first word's place, number of words
    and words.
    """
    hot = np.sort(hot.view(np.uint64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kept(("none",), dict)
        press = zstandard.ZstdCompressor(level=1)
        for ids, b in _blocks(batches, block_bytes):
            value, at, n = super_kmers(b, window, run)
            if not len(at):
                continue
            target = (mix(value ^ _MULTIPLIER) % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
                if is_hot.any():
                    k = n[is_hot]
                    single = np.repeat(at[is_hot], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    by_words = (hash_runs(b.hash, window)[single] % np.uint64(buckets)).astype(np.int64)
                    at, n = np.append(at[~is_hot], single), np.append(n[~is_hot], np.ones(len(single), np.int64))
                    target = np.append(target[~is_hot], by_words)
                    order = np.argsort(at, kind="stable")
                    at, n, target = at[order], n[order], target[order]
            text, begin = b.packed()
            stop = at + n + window - 1
            doc = b.doc[at]
            place = at - b.first[doc]
            seen: dict[bytes, int] = {}
            strings: list[bytes] = []
            earliest = np.empty(len(at), np.int64)  # the row of the block that first had the same words
            for i, (x, y) in enumerate(zip(begin[at].tolist(), begin[stop].tolist(), strict=True)):
                s = text[x : y - 1]
                earliest[i] = seen.setdefault(s, i)
                if earliest[i] == i:
                    strings.append(s)
            keep = earliest == np.arange(len(at))
            again = (ids[doc] != ids[doc[earliest]]) | (place != place[earliest])
            if again.any():
                yield from _marks(_joined(ids[doc[again]], place[again], place[again] + n[again] + window - 1), buckets)
            order = np.argsort(target[keep], kind="stable")
            head = np.stack([ids[doc[keep]], place[keep], n[keep] + window - 1])[:, order].astype(np.int64)
            target = target[keep][order]
            cuts = np.append(np.flatnonzero(np.diff(target, prepend=-1)), len(target)).tolist()
            rows: list[tuple[int, bytes]] = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                body = b" ".join([strings[k] for k in order[x:y].tolist()])
                rows.append((int(target[x]), press.compress(np.int64(y - x).tobytes() + head[:, x:y].tobytes() + body)))
                if len(rows) == 64 or y == len(target):
                    none = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), none, none, none], _PACKED)
                    rows = []

    return docs.mapInArrow(pack, f"bucket long, payload binary, {_MARKS}")


_PACKED = ["bucket", "payload", "id", "start", "stop"]


def _marks(spans: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Marked spans as rows among the payloads, dealt over all buckets."""
    for i in range(0, len(spans[0]), most):
        cols = [pa.array(x[i : i + most].astype(np.int64)) for x in spans]
        bucket = (np.arange(len(cols[0])) + i) % buckets
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(bucket), pa.binary()), *cols], _PACKED)


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, made one; sorts by document and start."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if len(doc) < 2:
        return doc, start, stop
    # With a document's ends raised above all before it, a running maximum stays within the document.
    rank = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    lift = rank * (stop.max() + 1)
    reach = np.maximum.accumulate(stop + lift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    return doc[begin], start[begin], reach[last] - lift[last]


def _repeated(payloads: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a bucket's windows that aren't the earliest of their words."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    heads, bodies = [], []
    for p in payloads:
        p = unpress.decompress(p)
        n = int(np.frombuffer(p, np.int64, 1)[0])
        heads.append(np.frombuffer(p, np.int64, 3 * n, 8).reshape(3, n))
        bodies.append(p[8 + 24 * n :])
    doc, place, size = np.concatenate(heads, axis=1)
    text = pa.array([b" ".join(bodies)], pa.large_binary())
    words = pc.list_flatten(pc.split_pattern(text.cast(pa.large_string()), " "))
    code = words.dictionary_encode().indices
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).to_numpy(zero_copy_only=False).astype(np.int64)
    n = size - window + 1
    skip = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = skip[row] + offset  # where each window begins in the bucket's words
    h = hash_runs(mix(code.astype(np.uint64) + np.uint64(1)), window)[at]
    d, s = doc[row], place[row] + offset
    order = np.lexsort((s, d, h))
    h, d, s, at = h[order], d[order], s[order], at[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    later = np.flatnonzero(same)
    if not len(later):
        return d[:0], s[:0], s[:0]
    # Equal hashes are taken for equal words only after a comparison with the group's earliest.
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    equal = np.ones(len(later), bool)
    for i in range(window):
        equal &= code[at[later] + i] == code[at[leader[later]] + i]
    if not equal.all():  # one hash for different words: such groups go by the words themselves
        first: dict[bytes, int] = {}
        clash = np.isin(leader, leader[later[~equal]])
        for i in np.flatnonzero(clash).tolist():
            leader[i] = first.setdefault(code[at[i] : at[i] + window].tobytes(), i)
    marked = later[(d[later] != d[leader[later]]) | (s[later] != s[leader[later]])]
    return _joined(d[marked], s[marked], s[marked] + window)


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, run: int = 4, block_bytes: int = 3 << 20, buckets_per_partition: int = 8, bucket_bytes: int = 8 << 20, hot_rows: int = 1000) -> DataFrame:
    """(id, start, stop): spans of words [start, stop) covered by windows whose words also start earlier.

    Earlier means a smaller id, or the same document and an earlier start. Spans of one document may
    overlap. Rows that repeat an id and its text count as one document. Rows with a null id have no place
    in the order: they neither lose words nor make others lose them. Null texts have no words.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    counts = cut(minimiser_counts(docs, window, run, block_bytes))
    total, size = counts.agg(F.sum(F.when(F.col("minimiser").isNotNull(), F.col("n"))), F.sum(F.when(F.col("minimiser").isNull(), F.col("n")))).first()
    total = total or 0
    # A bucket is held in memory: there are as many as keep it at about ``bucket_bytes``.
    buckets = max(buckets_per_partition * partitions(spark), -(-(size or 0) // bucket_bytes))
    # At most 8 * buckets values can exceed this share of the total: a bound on what is collected.
    least = max(hot_rows, total // (8 * buckets))
    hot = np.array([r[0] for r in counts.where(F.col("minimiser").isNotNull() & (F.col("n") > least)).select("minimiser").collect()], np.int64)

    def in_bucket(t: pa.Table) -> pa.Table:
        kept(("none",), dict)
        marked = t.filter(pc.is_null(t["payload"])).select(["id", "start", "stop"])
        payloads = t["payload"].drop_null().to_pylist()
        if not payloads:
            return marked
        out = pa.concat_tables([marked, pa.table(dict(zip(("id", "start", "stop"), _repeated(payloads, window), strict=True)))])
        pa.default_memory_pool().release_unused()
        return out

    return _pack(docs, hot, buckets, window, run, block_bytes).groupBy("bucket").applyInArrow(in_bucket, _MARKS)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text) with a key that orders documents: the id, or where ids are repeated the place of (id, SHA-256 of the text) among all; null where the id is."""
    ids = docs.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1)
    if not ids.count():
        return docs.withColumn("key", F.col("doc"))
    order = ["doc", "digest"]
    docs = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    places = docs.where("doc is not null").select(*order).distinct().repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # Partitions are ranges in order and sorted, so these numbers ascend over all of them.
    places = cut(places.withColumn("key", F.monotonically_increasing_id()))
    return docs.join(places, order, "left").select("doc", "text", "key")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, run: int = 4, **sizes: int) -> DataFrame:
    """(id, text, n_words, n_removed): each row of ``df`` with its kept words, joined by one blank.

    A word goes when some window over it also starts earlier in the input. A null text stays null, with
    no words; an empty one stays empty. Rows that repeat an id and its text come out alike; rows that repeat an
    id with other texts are documents of their own, one after the other by the SHA-256 of their texts; a row with a
    null id stays whole. Columns of ``df`` other than the two named are not read.
    """
    docs = keyed(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))
    spans = repeated_spans(docs, id_col="key", window=window, run=run, **sizes)
    # A document's spans are at most as many as its words.
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    docs = docs.join(spans, F.col("key") == spans["id"], "left").select("doc", "text", "spans.start", "spans.stop")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts, words, removed = [], [], []
            for text, start, stop in zip(b["text"].to_pylist(), b["start"].to_pylist(), b["stop"].to_pylist(), strict=True):
                w = [x for x in _split(text) if x] if text else []
                gone = _covered(start, stop, len(w)).tolist()
                w_kept = [x for x, g in zip(w, gone, strict=True) if not g]
                texts.append(None if text is None else " ".join(w_kept))
                words.append(len(w))
                removed.append(len(w) - len(w_kept))
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], ["id", "text", "n_words", "n_removed"])

    return docs.mapInArrow(keep, "id long, text string, n_words long, n_removed long")


def _covered(start: list[int] | None, stop: list[int] | None, n: int) -> np.ndarray:
    """Whether some span [start, stop) covers each of ``n`` words."""
    gone = np.zeros(n + 1, np.int64)
    if start:
        np.add.at(gone, np.minimum(start, n), 1)
        np.subtract.at(gone, np.minimum(stop, n), 1)
    return np.cumsum(gone)[:n] > 0


def without(df: DataFrame, spans: DataFrame, *, id_col: str, text_col: str = "text") -> DataFrame:
    """``df`` with the words of ``spans`` cut out of its texts, and with n_words and n_removed of each row.

    ``spans`` are those of ``repeated_spans``; ``id_col`` names one row each, and rows that it leaves null stay
    whole. All columns of ``df`` go along with their row. Characters outside the spans, blanks around them
    included, stay as they are.
    """
    names = df.columns
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("__spans")).withColumnRenamed("id", "__of")
    rows = df.join(spans, F.col(id_col) == F.col("__of"), "left").select(*names, F.col("__spans.start").alias("__start"), F.col("__spans.stop").alias("__stop"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            texts, words, removed = [], [], []
            for text, start, stop in zip(b[text_col].to_pylist(), b["__start"].to_pylist(), b["__stop"].to_pylist(), strict=True):
                w = [m.span() for m in _WORD.finditer(text)] if text else []
                gone = _covered(start, stop, len(w))
                # Where runs of words that go begin and end.
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                kept, at = [], 0
                for x, y in zip(edge[::2], edge[1::2], strict=True):
                    kept.append(text[at : w[x][0]])
                    at = w[y - 1][1]
                texts.append("".join([*kept, text[at:]]) if kept else text)
                words.append(len(w))
                removed.append(int(gone.sum()))
            columns = [pa.array(texts, b[c].type) if c == text_col else b[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    return rows.mapInArrow(keep, StructType([*df.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def _split(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return text.split(" ")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
