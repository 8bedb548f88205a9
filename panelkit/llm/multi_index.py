"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, fitted apart on the halves of a bounded sample, span a grid of cells. A vector lies in the cell
of its nearest centroids. To find the vectors within the threshold it visits cells in the order of cost, by a
multi-sequence traversal of the two halves' sorted costs, where a half's cost for a centroid is the squared
distance to the border with the nearest centroid's cell. It stops at the cost within which the target
recall of neighbours lies, measured on sampled vectors moved to just the threshold in random directions.
Members of visited cells are then verified by exact cosines.

Equal vectors are one class and enter once. Cells meet as blocks of bounded size: a hot cell has many blocks,
and a visitor meets each. A block's task returns link counts and, instead of pairs, one edge a vector to the
least id that it is connected with inside the block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import components, cut
from panelkit.llm.toxicity import sampled


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows that can be compared: with an id, and a vector of finite components, not all zero.

    Vectors must also have the length that most have (of equal frequent ones the smaller).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where("id is not null and v is not null").where(~bad & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths[0] if lengths else 0))


def unit(m: np.ndarray) -> np.ndarray:
    # Dividing by the largest component first keeps squares of tiny and huge numbers in range.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def classes_of(rows: DataFrame) -> DataFrame:
    """(key, id, n, v): one row for each distinct vector, with its least id and its count."""
    rows = rows.withColumn("key", F.md5(F.to_json(F.struct("v")).cast("binary")))
    return rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))


@dataclass
class Grid:
    books: tuple[np.ndarray, np.ndarray]
    border: tuple[np.ndarray, np.ndarray]  # distances between centroids
    stop: float

    def _costs(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        half = self.books[0].shape[1]
        near, costs = [], []
        for part, book, between in zip((x[:, :half], x[:, half:]), self.books, self.border, strict=True):
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            i = d.argmin(1)
            gap = (d - d[np.arange(len(d)), i][:, None]) / (2 * np.maximum(between[i], 1e-12))
            costs.append(np.where(np.arange(len(book)) == i[:, None], 0.0, gap * gap))
            near.append(i)
        return near, costs

    def cells(self, x: np.ndarray) -> np.ndarray:
        (i, j), _ = self._costs(x)
        return i * len(self.books[1]) + j

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The own cell of each unit vector, and the cells that it visits, nearest first."""
        (i, j), (a, b) = self._costs(x)
        k = len(self.books[1])
        return i * k + j, [self._walk(p, q, k) for p, q in zip(a, b, strict=True)]

    def _walk(self, a: np.ndarray, b: np.ndarray, k: int) -> list[int]:
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[oa].tolist(), b[ob].tolist()
        heap, out = [(sa[0] + sb[0], 0, 0)], []
        while heap:
            cost, p, q = heapq.heappop(heap)
            if cost > self.stop:
                break
            out.append(int(oa[p]) * k + int(ob[q]))
            # Every place is pushed once: down a column from its head, and along the first row.
            if q + 1 < len(sb):
                heapq.heappush(heap, (sa[p] + sb[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(sa):
                heapq.heappush(heap, (sa[p + 1] + sb[0], p + 1, 0))
        return out


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = ((book * book).sum(1) - 2 * x @ book.T).argmin(1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.unique(book, axis=0)


def fit(sample: np.ndarray, k: int, threshold: float, target_recall: float, seed: int = 0) -> Grid:
    """Codebooks of ``k`` centroids a half from unit vectors, and the cost at which ``target_recall`` is reached."""
    rng = np.random.default_rng(seed)
    half = (sample.shape[1] + 1) // 2
    books = tuple(_codebook(part, k, rng) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, :half], sample[:, half:]))
    border = tuple(np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)) for b in books)
    grid = Grid(books, border, np.inf)
    moved = rng.normal(size=sample.shape)
    moved = moved - (moved * sample).sum(1, keepdims=True) * sample
    moved = moved / np.maximum(np.sqrt((moved * moved).sum(1, keepdims=True)), 1e-12)
    moved = threshold * sample + np.sqrt(1 - threshold**2) * moved
    (i, j), _ = grid._costs(moved)
    _, (a, b) = grid._costs(sample)
    cost = a[np.arange(len(a)), i] + b[np.arange(len(b)), j]
    grid.stop = float(np.quantile(cost, target_recall, method="higher"))
    return grid


def _met(v: pd.DataFrame, m: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts and edges of a block of visitors and a block of members: (id, n_links, least)."""
    if v.empty or m.empty:
        return pd.DataFrame({"id": [], "n_links": [], "least": []}, dtype=np.int64)
    ids, place = np.unique(np.concatenate([v["id"].to_numpy(), m["id"].to_numpy()]), return_inverse=True)
    vi, mi = place[: len(v)], place[len(v) :]
    x, y = unit(np.stack(v["v"].to_numpy())), unit(np.stack(m["v"].to_numpy()))
    v_n, m_n, v_cell, m_visits = v["n"].to_numpy(), m["n"].to_numpy(), v["own"].to_numpy(), m["visits"].to_numpy()
    m_visits, cell = [set(x) for x in m_visits], m["own"].iloc[0]
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    pairs = []
    for s in range(0, len(x), 512):
        a, b = np.nonzero(x[s : s + 512] @ y.T >= threshold)
        a = a + s
        other = vi[a] != mi[b]
        a, b = a[other], b[other]
        np.add.at(links, vi[a], m_n[b])
        # A pair is also found from its other side if the member visits the visitor's cell; else both count here.
        far = np.flatnonzero(v_cell[a] != cell)
        once = far[np.fromiter((c not in m_visits[k] for c, k in zip(v_cell[a[far]].tolist(), b[far].tolist(), strict=True)), bool, len(far))]
        np.add.at(links, mi[b[once]], v_n[a[once]])
        pairs.append(np.stack([vi[a], mi[b]]))
    p, q = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    some = np.unique(np.concatenate([p, q]))
    return pd.DataFrame({"id": ids[some], "n_links": links[some], "least": ids[label[some]]})


def near_duplicate_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, target_recall: float = 0.995, sample_rows: int = 8192, cell_rows: int = 1000, block_rows: int = 2048, seed: int = 0) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Vectors with a cosine of at least ``threshold`` in double precision link. Rows without a usable vector
    (null, zero, null or non-finite components, a length other than the usual one) or id link with nothing
    and are kept. The codebooks come from a hashed sample of about ``sample_rows`` distinct vectors; every vector is
    indexed and visits. ``target_recall`` holds for neighbours at just the threshold in random directions,
    from one of a pair's two sides.
    """
    rows = usable(df, id_col, vec_col)
    classes = cut(classes_of(rows))
    n = classes.count()
    sample = classes.where(sampled("id", sample_rows, n)).select("v").collect() or classes.select("v").limit(1).collect()
    everyone = df.select(F.col(id_col).cast("long").alias("id"))
    if not sample:
        return everyone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    k = int(min(1024, max(2, np.ceil(np.sqrt(n / cell_rows)))))
    grid = fit(unit(np.array([r[0] for r in sorted(sample)])), k, threshold, target_recall, seed)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, visits = grid.visits(unit(matrix(b["v"])))
                yield pa.RecordBatch.from_arrays([b["id"], b["n"], b["v"], pa.array(own), pa.array(visits, pa.list_(pa.int64()))], ["id", "n", "v", "own", "visits"])

    at = cut(classes.select("id", "n", "v").mapInArrow(placed, "id long, n long, v array<double>, own long, visits array<long>"))
    members = at.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("m"))
    visitors = at.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("w"))
    blocks = members.join(visitors, "cell").select("cell", F.ceil(F.col("m") / block_rows).cast("int").alias("gm"), F.ceil(F.col("w") / block_rows).cast("int").alias("gv"))
    both = ["id", "n", "v", "own", "visits"]
    m = at.withColumn("cell", F.col("own")).join(blocks, "cell")
    m = m.select("cell", F.pmod(F.xxhash64("id"), "gm").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("gv") - 1)).alias("vb"), F.lit(True).alias("member"), *both)
    v = at.withColumn("cell", F.explode("visits")).join(blocks, "cell")
    v = v.select("cell", F.explode(F.sequence(F.lit(0), F.col("gm") - 1)).alias("mb"), F.pmod(F.xxhash64("id"), "gv").cast("int").alias("vb"), F.lit(False).alias("member"), *both[:-1], F.array().cast("array<bigint>").alias("visits"))

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        return _met(b[~b["member"]], b[b["member"]], threshold)

    found = cut(m.union(v).groupBy("cell", "mb", "vb").applyInPandas(meet, "id long, n_links long, least long"))
    links = found.groupBy("id").agg(F.sum("n_links").alias("found"))
    parts = components(found.where("id != least").select(F.col("id").alias("src"), F.col("least").alias("dst")))
    of_class = classes.select("key", "id", "n").join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("key", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    keyed = rows.withColumn("key", F.md5(F.to_json(F.struct("v")).cast("binary"))).select("id", "key")
    linked = keyed.join(of_class, "key").select("id", "n_links", "component_id")
    rest = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    alone = rest.join(linked.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
