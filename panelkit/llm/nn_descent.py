"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

The graph starts from neighbours inside small blocks along random projections. In each round a vector meets a
sample of its neighbours and of those whose neighbour it is: Spark joins bring their codes together, every
pair of them is compared of which one is new there, and those that improve a list are sent to it. Codes are
vectors in single bytes; lists hold ``neighbours`` entries.

A query starts from its own place in the graph, if it has one, and from fixed entry points. In each hop it
expands the best not yet expanded nodes of its pool: its code goes to them and is compared there with those of their
neighbours in both directions. The best of the pool are at last compared exactly, on the original vectors.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.minhash import mix
from panelkit.llm.multi_index import classes_of, matrix, unit, usable
from panelkit.llm.shared import cut, drop, partitions
from panelkit.llm.toxicity import sampled

_LISTS = "id long, nbr array<long>, sim array<float>"
#: Rows that a task compares at once.
_ROWS = 1024
_SEED = np.uint64(0x9E3779B97F4A7C15)


def codes(classes: DataFrame) -> DataFrame:
    """(id, code): unit vectors scaled to signed bytes, with one scale each as a last float."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b["v"]))
                scale = np.abs(x).max(axis=1) / 127
                q = np.round(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b["id"], pa.array([r.tobytes() + np.float32(s).tobytes() for r, s in zip(q, scale, strict=True)], pa.binary())], ["id", "code"])

    return classes.select("id", "v").mapInArrow(run, "id long, code binary")


def decode(column: pa.Array | list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.uint8).reshape(len(column), -1)
    return raw[:, :-4].view(np.int8).astype(np.float32) * raw[:, -4:].copy().view(np.float32)


def _rows(column: pa.Array) -> np.ndarray:
    """The row of each element of a column of arrays; a null array has none."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n)


def _firsts(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where an id comes the first time in its row, both in order."""
    return np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[: len(row)]


def _firsts_of(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """As ``_firsts`` for ids in any order within their row."""
    o = np.lexsort((np.arange(len(row)), ids, row))
    out = np.zeros(len(row), bool)
    out[o[_firsts(row[o], ids[o])]] = True
    return out


def _place(row: np.ndarray) -> np.ndarray:
    return np.arange(len(row)) - np.searchsorted(row, row)


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def _initial(coded: DataFrame, neighbours: int, projections: int, block: int, seed: int) -> DataFrame:
    """Lists from the nearest inside blocks of consecutive vectors along random projections."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = decode(b["code"])
                for k in range(projections):
                    p = x @ np.random.default_rng(seed + k).normal(size=x.shape[1])
                    yield pa.RecordBatch.from_arrays([b["id"], b["code"], pa.array(np.full(len(x), k, np.int32)), pa.array(p)], ["id", "code", "k", "p"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A block lies on one projection.
            ends = np.append(np.flatnonzero(np.diff(b["k"].to_numpy())) + 1, b.num_rows)
            for begin, end in zip([0, *ends], ends, strict=False):
                for s in range(begin, end, block):
                    part = b.slice(s, min(block, end - s))
                    ids = part["id"].to_numpy()
                    x = decode(part["code"])
                    sim = x @ x.T
                    np.fill_diagonal(sim, -2)
                    m = min(neighbours // projections or 1, len(ids) - 1)
                    best = np.argsort(-sim, axis=1, kind="stable")[:, :m]
                    yield _lists(ids, np.full(len(ids), m), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel())

    # All projections go through one shuffle, ordered by their number first.
    order = ["k", "p", "id"]
    projected = coded.mapInArrow(project, "id long, code binary, k int, p double")
    return projected.repartitionByRange(partitions(coded.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(nearest, _LISTS)


def _lists(ids: np.ndarray, counts: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """A batch of lists: ``counts`` of the entries of ``nbr`` and ``sim`` belong to each of ``ids``."""
    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((nbr, pa.int64()), (sim.astype(np.float32), pa.float32()))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["id", "nbr", "sim"])


def _merged(lists: DataFrame, neighbours: int, sample: int = 16, salt: int = 0) -> DataFrame:
    """One list an id: its best distinct entries. Each partial list is bounded, and an id gets one from each place that met it.

    ``lists`` has (id, code, nbr, sim, state): a list of the round before has a code and a state for each entry, what was
    sent has neither. States of what comes out: _OLD and _NEW, and ``sample`` of each by hash as _OLD_MEETS and _NEW_MEETS,
    which meet in the next round; came counts the entries that were not there before.
    """
    # An entry that was sent is new, unless the list held it.
    state = F.coalesce("state", F.transform("nbr", lambda _: F.lit(_SENT).cast("tinyint")))
    grouped = lists.withColumn("state", state).groupBy("id").agg(F.first("code", ignorenulls=True).alias("code"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("nbr", "sim", "state")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                row, u, s, was = _rows(part["nbr"]), *(part[c].flatten().to_numpy() for c in ("nbr", "sim", "state"))
                o = np.lexsort((was, -s, u, row))
                first = np.flatnonzero(_firsts(row[o], u[o]))
                # The entry keeps its best value and its earliest state.
                earliest = np.minimum.reduceat(was[o], first) if len(first) else was[:0]
                o = o[first]
                k = np.lexsort((u[o], -s[o], row[o]))
                o, earliest = o[k], earliest[k]
                k = _place(row[o]) < neighbours
                row, u, s, was = row[o][k], u[o][k], s[o][k], earliest[k]
                came = np.bincount(row[was == _SENT], minlength=part.num_rows)
                fresh = (was == _SENT) | (was == _NEW)
                h = mix(part["id"].to_numpy().astype(np.uint64)[row] * _SEED + mix(u.astype(np.uint64) + np.uint64(salt)))
                o = np.lexsort((h, fresh, row))
                meets = np.zeros(len(row), bool)
                meets[o] = _place(2 * row[o] + fresh[o]) < sample
                state = np.where(fresh, np.where(meets, _NEW_MEETS, _NEW), np.where(meets, _OLD_MEETS, _OLD)).astype(np.int8)
                out = _lists(part["id"].to_numpy(), np.bincount(row, minlength=part.num_rows), u, s)
                states = pa.ListArray.from_arrays(out["nbr"].offsets, pa.array(state, pa.int8()))
                yield pa.RecordBatch.from_arrays([out["id"], part["code"], out["nbr"], out["sim"], states, pa.array(came, pa.int64())], _STATE_NAMES)

    return grouped.mapInArrow(run, _STATE)


_STATE = "id long, code binary, nbr array<long>, sim array<float>, state array<tinyint>, came long"
_STATE_NAMES = ["id", "code", "nbr", "sim", "state", "came"]
#: The states of an entry, those before the round first.
_OLD, _OLD_MEETS, _NEW_MEETS, _NEW, _SENT = range(5)


def _met(now: DataFrame, neighbours: int, sample: int, salt: int) -> DataFrame:
    """(id, met) of vectors that some others meet at: the entries of their lists that meet in this round, and ``sample`` new and
    ``sample`` old ones of those that list them, by hash. A pair may come from both.

    Whoever lists an id brings its own code along; only the entries of lists are joined with theirs.
    """
    # The worst entry of a list that isn't full yet is beaten by anything.
    worst = F.when(F.size("nbr") < neighbours, -2.0).otherwise(F.element_at("sim", -1)).cast("float").alias("worst")
    flat = now.select("id", "code", worst, F.explode(F.arrays_zip("nbr", "state")).alias("x"))
    flat = flat.select("id", "code", "worst", F.col("x.nbr").alias("other"), F.col("x.state").alias("state")).where(F.col("state").isin(_OLD_MEETS, _NEW_MEETS)).withColumn("fresh", F.col("state") == _NEW_MEETS)
    member = now.select(F.col("id").alias("other"), worst, "code")
    forward = flat.select("id", "other", "fresh").join(member, "other").select("id", "other", "worst", "code", "fresh")
    ranked = flat.select(F.col("other").alias("id"), F.col("id").alias("other"), "worst", "code", "fresh", F.xxhash64("id", "other", F.lit(salt)).alias("h"))
    backward = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id", "fresh").orderBy("h"))).where(F.col("r") <= sample)
    both = forward.union(backward.select(forward.columns))
    return both.groupBy("id").agg(F.collect_list(F.struct("other", "worst", "code", "fresh")).alias("met"), F.max("fresh").alias("any")).where("any").select("id", "met")


def _local_join(met: DataFrame, sends: int, neighbours: int) -> DataFrame:
    """Compare all pairs of each row's distinct ``met``; what beats a member's worst entry goes to that member, ``sends`` at most a row.

    Where members say whether they are ``fresh``, pairs of two that are not have met before and are left out. A member of many rows
    gets one list of its ``neighbours`` best from all of them that are compared at once, so a hub sends no more than others.
    """

    def compared(met: pa.Array) -> pa.RecordBatch:
        row, inner = _rows(met), met.flatten()
        ids = inner.field("other").to_numpy()
        says = inner.type.get_field_index("fresh") >= 0
        fresh = inner.field("fresh").to_numpy(zero_copy_only=False) if says else np.ones(len(ids), bool)
        o = np.lexsort((~fresh, ids, row))
        o = o[_firsts(row[o], ids[o])]
        row, place = row[o], _place(row[o])
        codes_ = decode(inner.field("code"))[o]
        # Rows get as many places as the longest has; places that a row lacks are beaten by nothing and beat nothing.
        shape = (len(met), place.max() + 1)
        x, member, worst = np.zeros((*shape, codes_.shape[1]), np.float32), np.full(shape, -1, np.int64), np.full(shape, np.inf, np.float32)
        lacks, old = np.ones(shape, bool), np.zeros(shape, bool)
        x[row, place], member[row, place], worst[row, place], lacks[row, place], old[row, place] = codes_, ids[o], inner.field("worst").to_numpy()[o], False, ~fresh[o]
        sim = x @ x.transpose(0, 2, 1)
        sim[lacks[:, None, :] | np.eye(shape[1], dtype=bool) | (old[:, :, None] & old[:, None, :])] = -2
        best = np.argpartition(-sim, min(sends, shape[1]) - 1, axis=2)[:, :, :sends]
        top = np.take_along_axis(sim, best, 2)
        better = (top > worst[:, :, None]) & (top > -2)
        to = np.broadcast_to(member[:, :, None], better.shape)[better]
        nbr, sim = member[np.arange(shape[0])[:, None, None], best][better], top[better]
        o = np.lexsort((nbr, -sim, to))
        o = o[_firsts_of(to[o], nbr[o])]
        o = o[_place(to[o]) < neighbours]
        ids, counts = np.unique(to[o], return_counts=True)
        return _lists(ids, counts, nbr[o], sim[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                yield compared(b["met"].slice(at, _ROWS))

    return met.mapInArrow(run, _LISTS)


def build(coded: DataFrame, *, neighbours: int = 32, sample: int = 16, rounds: int = 16, changed: float = 0.01, sends: int = 8, seed: int = 0) -> DataFrame:
    """(id, code, nbr, sim) for each (id, code): its near neighbours, best first.

    Rounds end when less than a share ``changed`` of all entries is new, or after ``rounds``. The search makes good what lists still lack then.
    A pair meets at a vector while one of the two is new there, so what has come to rest is compared and sent no more.
    """
    spark = coded.sparkSession
    columns = ["id", "code", "nbr", "sim", "state"]

    def sent(lists: DataFrame) -> DataFrame:
        return lists.select("id", F.lit(None).cast("binary").alias("code"), "nbr", "sim", F.lit(None).cast("array<tinyint>").alias("state"))

    none = coded.select("id", "code", F.array().cast("array<bigint>").alias("nbr"), F.array().cast("array<float>").alias("sim"), F.array().cast("array<tinyint>").alias("state"))
    now = cut(_merged(none.union(sent(_initial(coded, neighbours, 4, 256, seed))), neighbours, sample, seed))
    n = now.count()
    for k in range(rounds):
        met = _met(now, neighbours, sample, seed + k)
        # What met as new is old from here on.
        kept = now.withColumn("state", F.transform("state", lambda x: F.when(x == _NEW, x).otherwise(F.lit(_OLD)).cast("tinyint"))).select(columns)
        after = cut(_merged(kept.union(sent(_local_join(met.select("met"), sends, neighbours))), neighbours, sample, seed + k + 1))
        came = after.agg(F.sum("came")).first()[0] or 0
        drop(now)
        now = after
        _release(spark)
        if came < changed * neighbours * max(n, 1):
            break
    return now.select("id", "code", "nbr", "sim")


def _links(graph: DataFrame, most: int = 32) -> DataFrame:
    """(id, nbr, codes): a node's list and the ``most`` nearest of those that list it, with their codes."""
    flat = graph.select("id", "code", F.explode(F.arrays_zip("nbr", "sim")).alias("x"))
    flat = flat.select("id", "code", F.col("x.nbr").alias("other"), F.col("x.sim").alias("s"))
    forward = flat.select("id", "other").join(graph.select(F.col("id").alias("other"), "code"), "other").select("id", "other", "code")
    back = flat.select(F.col("other").alias("id"), F.col("id").alias("other"), "code", "s").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))).where(F.col("r") <= most)
    # A node that is in both comes twice at first.
    both = forward.union(back.select("id", "other", "code")).groupBy("id").agg(F.array_distinct(F.collect_list(F.struct("other", "code"))).alias("x"))
    return both.select("id", F.col("x.other").alias("nbr"), F.col("x.code").alias("codes"))


def search(graph: DataFrame, coded: DataFrame, queries: DataFrame, *, found: int = 64, pool: int = 160, expand: int = 64, hops: int = 100, entries: int = 256) -> DataFrame:
    """(query_id, id): the ``found`` nodes nearest to each of ``queries`` (query_id, code) that the search met, but not the query itself.

    A query is at its end when it has expanded all of its ``found`` best nodes, and takes part in hops until then; a search
    that is not at its end after ``hops`` is an error. A query's state is its pool, which is bounded and only gets better: a
    node that fell out of it is worse than all in it and stays out when it is met again, so no list of what was seen is kept.
    Without nodes nothing is found.
    """
    n = coded.count()
    links = cut(_links(graph))
    # Entry points: a hashed sample of about ``entries`` nodes, the same for all queries.
    start = [(r[0], bytes(r[1])) for r in coded.where(sampled("id", entries, n)).collect()] or [(r[0], bytes(r[1])) for r in coded.limit(1).collect()]
    if not start:
        return queries.select("query_id", F.col("query_id").alias("id")).limit(0)
    start_ids = np.array([s[0] for s in start])
    schema = "query_id long, code binary, ids array<long>, sims array<float>, open array<boolean>"

    def state(b: pa.RecordBatch, rows: Iterator[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.float32(), pa.bool_())
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), k)) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b["query_id"], b["code"], *lists], ["query_id", "code", "ids", "sims", "open"])

    def best(u: np.ndarray, s: np.ndarray, o: np.ndarray) -> tuple:
        k = np.lexsort((u, -s))[:pool]
        return u[k], s[k], o[k]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = decode([s[1] for s in start])
        for b in batches:
            if b.num_rows:
                sims = decode(b["code"]) @ e.T

                def rows(b: pa.RecordBatch = b, sims: np.ndarray = sims) -> Iterator[tuple]:
                    for q, s in zip(b["query_id"].to_pylist(), sims, strict=True):
                        other = start_ids != q
                        # The query's own node, if the graph has it, is expanded first; it is never a result.
                        u, v = np.append(start_ids[other], q), np.append(s[other], np.float32(2))
                        yield best(u, v, np.ones(len(u), bool))

                yield state(b, rows())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a query meets at the node that it expands, unless it is worse than all of a full pool."""
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                row, u = _rows(part["nbr"]), part["nbr"].flatten().to_numpy()
                s = (decode(part["codes"].flatten()) * decode(part["code"])[row]).sum(axis=1)
                k = (s >= part["worst"].to_numpy()[row]) if len(s) else np.zeros(0, bool)
                lists = _lists(part["query_id"].to_numpy(), np.bincount(row[k], minlength=part.num_rows), u[k], s[k])
                yield pa.RecordBatch.from_arrays(list(lists.columns), ["query_id", "nbr", "sim"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge what was met into the pools, and close what was expanded."""
        for b in batches:
            if not b.num_rows:
                continue

            def rows(b: pa.RecordBatch = b) -> Iterator[tuple]:
                met, found_sims = (b[c].flatten().to_numpy() for c in ("nbr", "sim"))
                ends = np.cumsum(np.bincount(_rows(b["nbr"]), minlength=b.num_rows))
                for k, end in enumerate(ends.tolist()):
                    ids, sims = (b[c][k].values.to_numpy() for c in ("ids", "sims"))
                    open_ = b["open"][k].values.to_numpy(zero_copy_only=False).copy()
                    open_[np.flatnonzero(open_)[:expand]] = False
                    begin_ = ends[k - 1] if k else 0
                    new, at = np.unique(met[begin_:end], return_index=True)
                    # What the pool holds stays as it is there.
                    lacks = ~np.isin(new, ids)
                    if lacks.any():
                        ids, sims, open_ = best(np.append(ids, new[lacks]), np.append(sims, found_sims[begin_:end][at[lacks]]), np.append(open_, np.ones(int(lacks.sum()), bool)))
                    yield ids, sims, open_

            yield state(b, rows())

    now = cut(queries.select("query_id", "code").mapInArrow(begin, schema))
    ended: list[DataFrame] = []
    for _ in range(hops):
        open_ids = F.filter(F.transform(F.arrays_zip("ids", "open"), lambda x: F.when(x["open"], x["ids"])), lambda x: x.isNotNull())
        worst = F.when(F.size("sims") < pool, -2.0).otherwise(F.element_at("sims", -1)).cast("float").alias("worst")
        frontier = now.select("query_id", "code", worst, F.explode(F.slice(open_ids, 1, expand)).alias("id"))
        met = frontier.join(links, "id").select("query_id", "code", "worst", "nbr", "codes").mapInArrow(compared, "query_id long, nbr array<long>, sim array<float>")
        got = met.groupBy("query_id").agg(F.flatten(F.collect_list("nbr")).alias("nbr"), F.flatten(F.collect_list("sim")).alias("sim"))
        after = cut(now.join(got, "query_id", "left").mapInArrow(closed, schema))
        if not ended:
            drop(now)
        going = F.exists(F.slice("open", 1, found), lambda x: x)
        ended.append(after.where(~going).select("query_id", "ids"))
        now = after.where(going)
        _release(now.sparkSession)
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"the search is not at its end after {hops} hops")
    now = reduce(DataFrame.union, ended)
    out = now.select("query_id", F.explode(F.slice(F.array_remove("ids", F.col("query_id")), 1, found)).alias("id"))
    return out


def nearest(df: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of ``df`` found for each row of ``queries``, itself left out.

    ``queries`` are rows of ``df``. score is the cosine in double precision on the original vectors; ties
    go to the smaller id. Rows without a usable vector or id take no part. Equal vectors are one node of
    the graph; a node brings as many of its smallest ids as a result can hold. With fewer candidates
    than ``k``, all are returned. Of rows that repeat an id the one of the least vector counts, in the order of its numbers. Other columns
    are not read; an empty table gives no rows.
    """
    rows = usable(df, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    keyed = cut(rows.withColumn("key", F.md5(F.to_json(F.struct("v")).cast("binary"))))
    classes = cut(classes_of(keyed.select("id", "v")))
    coded = cut(codes(classes))
    graph = build(coded, **{n: v for n, v in sizes.items() if n in ("neighbours", "sample", "rounds", "changed", "sends", "seed")})
    asked = queries.select(F.col(id_col).cast("long").alias("query")).where("query is not null").distinct()
    asked = cut(keyed.join(asked, F.col("id") == F.col("query")).join(classes.select("key", F.col("id").alias("node")), "key").select("query", "node", "v"))
    nodes = asked.select(F.col("node").alias("query_id")).distinct().join(coded.withColumnRenamed("id", "query_id"), "query_id")
    hits = search(graph, coded, nodes, **{n: v for n, v in sizes.items() if n in ("found", "pool", "expand", "hops", "entries")})
    hits = hits.union(nodes.select("query_id", F.col("query_id").alias("id"))).select(F.col("query_id").alias("node"), F.col("id").alias("hit"))
    # The k + 1 smallest ids of a class: the query itself may be among them.
    ranked = keyed.select("key", F.col("id").alias("member")).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("member"))).where(F.col("r") <= k + 1)
    first = ranked.groupBy("key").agg(F.collect_list("member").alias("members"))
    nodes_of = classes.select("key", F.col("id").alias("hit"), F.col("v").alias("w")).join(first, "key").drop("key")
    pairs = asked.join(hits, "node").join(nodes_of, "hit")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = matrix(b["v"]), matrix(b["w"])
                x, y = unit(x), unit(y)
                yield pa.RecordBatch.from_arrays([b["query"], b["members"], pa.array((x * y).sum(axis=1))], ["query", "members", "score"])

    out = pairs.select("query", "members", "v", "w").mapInArrow(scored, "query long, members array<long>, score double")
    out = out.select(F.col("query").alias("query_id"), "score", F.explode("members").alias("id")).where("id != query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
