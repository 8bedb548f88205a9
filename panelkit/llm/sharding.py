"""Sharding by sampled splitters: shards of nearly equal bytes.

A document's key is a 64-bit hash of its text, so that equal texts lie together. A size-weighted hashed sample
of keys gives quantile boundaries of many small ranges, into which all documents are counted. A range that
is overfull, by a bad draw or as its key alone is large, is divided again by boundaries sampled inside it:
between its keys, or, where it holds one key, between hashes of the documents' ids. The ranges of one key go
together if they fit a shard. Shards are made of ranges by their exact bytes, the largest first, each to the
shard that has least: they differ by no more than the last small ranges. A document's place in its shard is its rank inside
its range plus the counts of the shard's ranges before.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.shared import cut

_LOWEST = -(1 << 63)


def located(bounds: list[tuple[int, int]]):  # noqa: ANN201
    """A function of (key, sub) columns: the number of a row's range, of those that begin at sorted ``bounds``."""
    keys, subs = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def of(key: pd.Series, sub: pd.Series) -> pd.Series:
        k, s = key.to_numpy(), sub.to_numpy()
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        at = lo.copy()
        for first in np.unique(lo[hi > lo]):  # rows whose key is itself a bound go by their sub
            mine = (lo == first) & (hi > lo)
            at[mine] += np.searchsorted(subs[first : hi[mine][0]], s[mine], "right")
        return pd.Series((at - 1).astype(np.int32))

    return of


def split(rows: DataFrame, parts: int, oversample: int = 16, rounds: int = 4) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where about ``parts`` ranges of ``rows`` (id, size, key, sub) begin, and (bytes, rows) in each.

    What the driver holds is ``oversample`` numbers and one count for each range.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    ideal = max(1.0, total / parts)
    # The draw is of the row, not of its key: copies of a text are drawn apart.
    draw = F.pmod(F.xxhash64("id", "key", "sub", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = sorted(r[0] for r in rows.where(draw < F.col("size") / F.lit(ideal) * F.lit(float(oversample))).select("key").collect())
    bounds = [(_LOWEST, _LOWEST)] + [(k, _LOWEST) for k in sorted({sample[len(sample) * i // parts] for i in range(1, parts)} if sample else ())]

    def count() -> list[tuple[int, int]]:
        found = {r[0]: (r[1], r[2]) for r in rows.groupBy(located(bounds)("key", "sub").alias("r")).agg(F.sum("size"), F.count("*")).collect()}
        return [found.get(i, (0, 0)) for i in range(len(bounds))]

    counts = count()
    for k in range(rounds):
        over = {i: c[0] for i, c in enumerate(counts) if c[0] > 2 * ideal and c[1] > 1}
        if not over:
            break
        inside = rows.withColumn("r", located(bounds)("key", "sub")).where(F.col("r").isin(list(over)))
        draw = F.pmod(F.xxhash64("id", "key", "sub", F.lit(11 + k)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn: dict[int, list[tuple[int, int]]] = {}
        for r in inside.where(draw < F.col("size") / F.lit(ideal) * F.lit(float(oversample))).select("r", "key", "sub").collect():
            drawn.setdefault(r[0], []).append((r[1], r[2]))
        new = set()
        for i, pairs in drawn.items():
            pairs.sort()
            n = int(np.ceil(over[i] / ideal))
            at = [pairs[len(pairs) * j // n] for j in range(1, n)]
            keys = {(p[0], _LOWEST) for p in at} | {(p[0] + 1, _LOWEST) for p in at if p[0] < (1 << 63) - 1}
            inner = {b for b in keys if b > bounds[i] and (i + 1 == len(bounds) or b < bounds[i + 1])}
            new |= inner if len({p[0] for p in pairs}) > 1 else set(at)
        if new <= set(bounds):
            break
        bounds = sorted(set(bounds) | new)
        counts = count()
    return bounds, counts


def assigned(bounds: list[tuple[int, int]], counts: list[tuple[int, int]], shards: int) -> list[int]:
    """The shard of each range: the largest first, to the shard with least. Ranges of one divided key stay together if a shard holds them."""
    total, by_key = sum(c[0] for c in counts), {}
    for i, (key, _) in enumerate(bounds):
        by_key.setdefault(key, []).append(i)
    units: list[tuple[int, list[int]]] = []
    for at in by_key.values():
        size = sum(counts[i][0] for i in at)
        units += [(size, at)] if size * shards <= total else [(counts[i][0], [i]) for i in at]
    filled, out = [(0, k) for k in range(shards)], [-1] * len(bounds)
    for size, at in sorted(units, key=lambda u: (-u[0], u[1])):
        least, k = heappop(filled)
        heappush(filled, (least + size, k))
        for i in at:
            out[i] = k
    return out


def place(df: DataFrame, *, shards: int = 24, ranges_per_shard: int = 32, range_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``carry`` alone, with columns size, shard and slot.

    size is the UTF-8 bytes of the text, none for a null one, plus 8. Shards have nearly equal bytes: they
    differ by less than a range, 1 / ``ranges_per_shard`` of a shard, or a document larger than that. There are more ranges where
    else they would pass ``range_bytes``. Copies of a text share a shard, unless they alone are larger than one
    shard's equal part. slot counts from 0 without holes in each shard, in the order of keys. Null ids and texts
    hash to keys of their own; identical rows lie in one range. An empty table gives an empty frame. Columns
    of ``df`` called size, shard or slot are replaced.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c not in ("size", "shard", "slot")]
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(*keep, F.col(id_col).alias("__id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.xxhash64(text).alias("__key"), F.xxhash64(F.col(id_col), F.lit(3)).alias("__sub"))
    narrow = cut(df.select(F.col("__id").alias("id"), "size", F.col("__key").alias("key"), F.col("__sub").alias("sub")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    bounds, counts = split(narrow, max(shards * ranges_per_shard, total // range_bytes))
    table, placed = [], [0] * shards
    for i, (k, (_, n)) in enumerate(zip(assigned(bounds, counts, shards), counts, strict=True)):
        table.append((i, k, placed[k]))
        placed[k] += n
    # One row a range.
    ranges = F.broadcast(df.sparkSession.createDataFrame(table, "__r int, shard int, __before long"))
    order = Window.partitionBy("__r").orderBy("__key", "__sub", "__id", "size")
    out = df.withColumn("__r", located(bounds)("__key", "__sub")).withColumn("__own", F.row_number().over(order) - 1)
    return out.join(ranges, "__r").select(*keep, "size", "shard", (F.col("__before") + F.col("__own")).cast("long").alias("slot"))
