"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

Steps, each a Spark shuffle over narrow rows:

1. A task hashes the word shingles of whole texts. Documents with the same set form a class; only the
   class with the smallest doc_id as its representative goes on, so that groups of exact copies of any
   size cost one row.
2. One permutation splits the hash range into bins and keeps the least hash of each; empty bins borrow
   from a bin that a second hash of (bin, attempt) names (optimal densification). Bins are grouped in
   bands, whose values are bucket keys.
3. In each bucket the member that meets most others over all bands is the centre of a star: n members
   make n - 1 candidate edges. Each edge is confirmed on the full sets.
4. Stars alone would lose a link between two members that both fail with the centre, or of which one
   does. Buckets whose members the confirmed links have not already joined are therefore gone through
   again: each member outside the bucket's largest component is paired with the members of the others.
   A member of the largest component needs no further test against its own component, as components are
   what is returned, which keeps the pairs of a large group of copies from being formed. One bit of each
   bin and a parity sketch of the whole set, compared inside the joins, leave out pairs that can't link,
   before any text is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import components, cut, kept, marked, text_slices

_SEED = np.uint64(0x9E3779B97F4A7C15)

#: Bits of a set's parity sketch.
PARITY = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, hashes: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    # On bytes, lower() and split() know ASCII letters and blanks only.
    h = hashes(text.encode().lower().split())
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    for i in range(k):
        s = mix(s * _SEED + h[i : i + n])
    return np.unique(s)


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """Least hash in each bin of one permutation; empty bins borrow by optimal densification."""
    p = mix(s ^ _SEED)
    at = (p % np.uint64(bins)).astype(np.int64)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, at, p)
    full = np.zeros(bins, bool)
    full[at] = True
    empty = np.flatnonzero(~full)
    own, attempt = out.copy(), 0
    while len(empty):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * _SEED + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[donor]
        out[empty[ok]] = own[donor[ok]]
        empty = empty[~ok]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for col in sig.reshape(bands, rows).T:
        key = mix(key * _SEED + col)
    return key.view(np.int64)


def bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each bin, in 64-bit words: equal in a share of (1 + similarity) / 2 of the bins."""
    one = (mix(sig) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.append(one, np.zeros(-len(one) % 64, np.uint8))).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits in 64-bit words: whether an odd number of the elements falls on each."""
    odd = np.bincount((mix(s + _SEED) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_link(bins: int, percent: int) -> Column:
    """Whether sketches (xb, yb: ``bits``, then ``parity``) and sizes (xn, yn) of two sets leave a link at ``percent`` possible.

    The differing bits of a linked pair stay within 5.5 standard deviations of what is expected at just the
    threshold but for one pair in ten million; a small set has no more independent bits than elements.

    Every differing parity bit has an element of its own that only one set holds, and a linked pair has at
    most a known number of those: below the parity sketch's size this test loses no link. For larger sets,
    whose parity bits overlap, the bound is the expected number and 5.5 standard deviations again.
    """

    def differing(first: int, end: int) -> Column:
        return reduce(lambda a, b: a + b, [F.bit_count(F.col("xb")[i].bitwiseXOR(F.col("yb")[i])) for i in range(first, end)])

    words = -(-bins // 64)
    p = (100 - percent) / 200
    slack = 5.5 * (p * (1 - p)) ** 0.5 / F.sqrt(F.least("xn", "yn", F.lit(bins)))
    # |A ^ B| of a linked pair: 1 - similarity over 1 + similarity of |A| + |B|.
    apart = (F.col("xn") + F.col("yn")) * (100 - percent) / (100 + percent)
    odd = PARITY / 2 * (1 - F.exp(-2 * apart / PARITY))
    spread = PARITY**0.5 / 2 * F.sqrt(1 - F.exp(-4 * apart / PARITY))
    by_size = 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
    by_bits = differing(0, words) <= bins * (p + slack)
    return by_size & by_bits & (differing(words, words + PARITY // 64) <= F.least(apart, odd + 5.5 * spread))


def sketches(df: DataFrame, words: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, bands, bits): set_key identifies the set by 128 bits, bands are its bucket keys, bits its sketches; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = kept(("words",), WordHashes)
        for b in text_slices(batches):
            rows = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = shingle_set(t, hashes, words)
                if len(s):
                    sig = signature(s, bands * rows_)
                    rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(sig, bands, rows_), np.concatenate([bits(sig), parity(s)])))
                else:
                    rows.append((i, 0, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SKETCH, strict=True)], _SKETCH_NAMES)

    rows_ = rows
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


_SKETCH_NAMES = ["id", "n_shingles", "set_key", "bands", "bits"]
_SKETCH = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, group: int = 64) -> DataFrame:
    """The (x, y) of ``pairs`` whose full sets have 100 * intersection >= percent * union, as (src, dst).

    Only the texts in some pair are shuffled, and the few others that a filter lets through: as text they take
    half the room of their sets. The pairs of a y
    are dealt into groups of about ``group``, whatever their number; y's text goes once to each group and stands
    before the group's others, so a task reads rows of one text and holds one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, centre = kept(("words",), WordHashes), np.empty(0, np.uint64)
        for b in text_slices(batches):
            found: list[tuple[int, int]] = []
            for x, y, text in zip(b["x"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = shingle_set(text, hashes, words)
                if x is None:
                    centre = s
                    continue
                both = len(s) + len(centre) - len(np.unique(np.concatenate([s, centre])))
                if 100 * both >= percent * (len(s) + len(centre) - both):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["src", "dst"])

    groups = pairs.groupBy("y").agg(F.ceil(F.count("*") / group).cast("long").alias("groups"))
    of = F.pmod(F.xxhash64("x"), F.col("groups"))
    # Where each text goes, both as an x and as a y, is known before the one join that moves texts.
    to_x = pairs.join(groups, "y").select(F.col("x").alias("id"), "x", "y", of.alias("g"))
    to_y = groups.select(F.col("y").alias("id"), F.lit(None).cast("long").alias("x"), "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
    # Most texts are in no pair: they stay where they lie.
    there = marked(texts, pairs.select(F.explode(F.array("x", "y")).alias("id")), "id").where("__marked").drop("__marked")
    placed = there.join(to_x.union(to_y), "id").select("x", "y", "g", "text")
    return placed.repartition("y", "g").sortWithinPartitions("y", "g", F.asc_nulls_first("x")).mapInArrow(run, "src long, dst long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``.

    Documents link when 100 * |A & B| >= percent * |A | B| for their shingle sets; component_id is the
    smallest id reachable over links. At the default bands a pair at 0.8 shares some bucket with
    probability 1 - (1 - 0.8**6)**40 > 0.99999.

    Texts that are null, empty or blank have an empty set and stay alone. A text with fewer words than a
    shingle is one shingle. Repeated rows of an id and text share a component; ids are taken to name one
    text. A null id stays alone, with a null component, and is kept. Columns of ``df`` other than the two
    named are not read, whatever their names.
    """
    docs = cut(sketches(df, words, bands, rows, id_col, text_col))
    classes = cut(docs.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep")))
    reps = docs.join(classes.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"], "left_semi").dropDuplicates(["id"])
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    # A bucket's key holds its band. A member's degree is what it meets over all bands: the likeliest
    # centre that links with the others.
    every = reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    bucket = every.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = cut(every.join(bucket, "key"))
    degree = member.groupBy("id").agg(F.sum("size").alias("degree"))
    sketch = reps.select("id", "bits").join(degree, "id")
    member = cut(member.join(sketch, "id").select("key", "id", "n", "bits", "degree"))
    centre = member.groupBy("key").agg(F.min_by(F.struct("id", "n", "bits"), F.struct(-F.col("degree"), "id")).alias("c"))
    centre = centre.select("key", F.col("c.id").alias("y"), F.col("c.n").alias("yn"), F.col("c.bits").alias("yb"))
    x = member.select("key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("bits").alias("xb"))
    linkable = may_link(bands * rows, percent)
    stars = cut(x.join(centre, (x["key"] == centre["key"]) & (F.col("x") != F.col("y")) & linkable).select("x", "y").distinct())
    links = cut(confirmed(stars, texts, words, percent))
    parts = cut(components(links))

    # What the stars left open: buckets that still hold several components.
    placed = member.select("key", "id", "n", "bits").join(parts.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("key", "id", "n", "bits", F.coalesce("component", "id").alias("part"))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("members"))
    largest = (
        counts.groupBy("key")
        .agg(F.max(F.struct("members", "part")).alias("top"), F.count("*").alias("n_parts"))
        .where("n_parts > 1")
        .select("key", F.col("top.part").alias("top"))
    )
    opened = cut(placed.join(largest, "key"))
    x = opened.where("part != top").select("key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("bits").alias("xb"), F.col("part").alias("xp"))
    y = opened.select("key", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("bits").alias("yb"), F.col("part").alias("yp"), "top")
    other = (F.col("xp") != F.col("yp")) & ((F.col("yp") == F.col("top")) | (F.col("x") < F.col("y")))
    more = (
        x.join(y, (x["key"] == y["key"]) & other & linkable)
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
        .join(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    )
    links = links.union(confirmed(cut(more), texts, words, percent))
    parts = cut(components(links))

    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("of_class"))
    out = docs.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("of_class", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
