"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

Templates are cut into pieces of up to 9 shingles of five words. A piece of n shingles is looked for in windows
of 2 * s shingles at steps of s, where s is the least power of two with n <= s + 1: wherever the piece
stands in a text, some window holds all of it. Pieces of one or two shingles, and those so short that the
least containment leaves none of their shingles out, are looked for in windows of just their length at every
place, where one band finds what isn't missing a shingle. A band is one MinHash; as many bands are taken as make
the chance that an occurrence with the least containment shares none with its piece at most ``most_missed``. A document
that shares a band with a piece is a candidate for its template, which the exact containment of the
template's shingles in the document's confirms.

Minima come from the xor of one shingle hash with a constant for each band, so a window costs no hashing.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public one-line license statements. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
PUNCTUATION = ".,;:!?()\"'"
_SHINGLE = 5
_PIECE = 9


def words_of(text: Column) -> Column:
    """Lower-case words without the marks in ``PUNCTUATION``."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    n = F.size(words) - _SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def least_shared(n: int, containment: float) -> int:
    """How many of a piece's ``n`` shingles an occurrence has at least."""
    return math.ceil(containment * n - 1e-9)


def scale(n: int, containment: float) -> int:
    """The step of windows for a piece of ``n`` shingles; 0, -1, -2, ... stand for windows of 1, 2, 3, ... at every place."""
    return 1 - n if n <= 2 or least_shared(n, containment) == n else 2 ** math.ceil(math.log2(n - 1))


def bands(n: int, containment: float, most_missed: float) -> int:
    """How many bands a piece of ``n`` shingles needs in the windows of its scale."""
    shared, step = least_shared(n, containment), scale(n, containment)
    j = shared / ((2 * step if step > 0 else n) + n - shared)
    return 1 if j == 1 else math.ceil(math.log(most_missed) / math.log(1 - j))


def _windows(h: Column, step: int, band: int) -> Column:
    """The least of each window's hashes under a band's xor. Elements are fetched by place: a slice would copy the array."""
    mask = F.lit(_constant(band))

    def minima(x: Column, width: int, stride: int, left: int, seen: Callable[[Column], Column] = lambda v: v) -> Column:
        """Of ``width`` elements at every ``stride``-th place, but for the last ``left`` places; least() skips what lies beyond the end."""
        last = F.greatest(F.size(x) - 1 - left, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.least(*[seen(F.get(x, i + k)) for k in range(width)]))

    if step > 0:  # a window is two blocks, and a block's minimum is taken once
        x, width = minima(h, step, step, 0, lambda v: v.bitwiseXOR(mask)), 2
    else:
        x, width = F.transform(h, lambda v: v.bitwiseXOR(mask)), 1 - step
    if width == 1:
        return x
    # The one-element array holds x, so that it is computed once.
    return F.flatten(F.transform(F.array(x), lambda x: minima(x, width, 1, width - 1)))


def _constant(band: int) -> int:
    return random.Random(band).getrandbits(64) - (1 << 63)


def _hits(h: Column, step: int, band: int, values: list[int]) -> Column:
    """struct(step, band, value) for each of ``values`` that is some window's minimum."""
    met = F.array_distinct(F.filter(_windows(h, step, band), lambda x: x.isin(values)))
    return F.transform(met, lambda x: F.struct(F.lit(step).alias("step"), F.lit(band).alias("band"), x.alias("value")))


def scan(df: DataFrame, *, templates: dict[str, str] = TEMPLATES, containment: float = 0.8, most_missed: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shared, containment): the templates that documents contain, one row for each pair.

    A match has at least ``containment`` of the template's distinct shingles in the whole text. Templates of
    fewer than five words have no shingle and never match; so do null, empty and shorter texts. Rows that
    repeat an id count as one document with the best containment. Other columns are not read. Templates
    are a parameter, so what is broadcast does not grow with the documents.
    """
    spark = df.sparkSession
    given = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, text string")
    known = {r[0]: list(r[1]) for r in given.select("license", shingle_hashes(words_of(F.col("text")))).collect() if r[1]}
    pieces = []
    for name, hashes in known.items():
        for i in range(0, len(hashes), _PIECE):
            pieces.append((name, hashes[max(0, min(i, len(hashes) - _PIECE)) : i + _PIECE]))
    wanted: dict[tuple[int, int], dict[int, set[str]]] = {}
    for name, piece in pieces:
        for band in range(bands(len(piece), containment, most_missed)):
            value = min((x ^ _constant(band)) for x in piece)
            wanted.setdefault((scale(len(piece), containment), band), {}).setdefault(value, set()).add(name)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("w")).select("doc_id", shingle_hashes(F.col("w")).alias("h"))
    hits = [_hits(F.col("h"), step, band, list(values)) for (step, band), values in sorted(wanted.items())]
    if not hits:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    keys = spark.createDataFrame([(s, b, v, n) for (s, b), values in wanted.items() for v, names in values.items() for n in sorted(names)], "step int, band int, value long, license string")
    full = spark.createDataFrame([(n, sorted(set(h))) for n, h in known.items()], "license string, shingles array<long>")
    # explode_outer keeps the optimiser from evaluating the hits twice, once as a filter.
    found = docs.select("doc_id", "h", F.explode_outer(F.concat(*hits)).alias("hit")).where("hit is not null")
    found = found.select("doc_id", "h", "hit.*").join(F.broadcast(keys), ["step", "band", "value"]).join(F.broadcast(full), "license")
    shared = F.size(F.array_intersect("shingles", "h"))
    found = found.select("doc_id", "license", shared.alias("n_shared"), (shared / F.size("shingles")).alias("containment")).where(F.col("containment") >= containment)
    return found.groupBy("doc_id", "license").agg(F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))
