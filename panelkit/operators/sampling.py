"""Deterministic sampling, top-k, and greedy batching under budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.contracts import ContractError, assert_unique
from panelkit.operators.ordered import batched
from panelkit.sources import written


def draw(key: str, stratum: Column, seed: int) -> Column:
    """The hash by which rows of a stratum are ordered: the same in any partitioning."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), stratum.cast("string"), F.col(key).cast("string")), 256)


def stratified(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: int, strict: bool = False) -> DataFrame:
    """The first ``quotas[stratum]`` rows of each stratum by hash; ``strict`` raises if a stratum has too few.

    Ranks above the quota are dropped before the shuffle, so a hot stratum costs a few rows a task.
    """
    quota = reduce(lambda acc, kv: F.when(F.col(stratum) == kv[0], F.lit(kv[1])).otherwise(acc), quotas.items(), F.lit(0))
    most = max(quotas.values(), default=0)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, F.col(stratum), seed), key))
    out = df.where(F.col(stratum).isin(list(quotas))).withColumn("rank_in_stratum", rank).where(F.col("rank_in_stratum") <= most).where(F.col("rank_in_stratum") <= quota)
    if strict:
        have = {r[0]: r[1] for r in out.groupBy(stratum).count().collect()}  # a row a stratum
        short = {s: (have.get(s, 0), q) for s, q in quotas.items() if have.get(s, 0) < q}
        if short:
            raise ContractError(f"strata with too few rows: {short}")
    return out


def sample_counts(sample: DataFrame, stratum: str, quotas: dict[str, int]) -> DataFrame:
    """(stratum, target, actual), also for strata that got nothing."""
    want = sample.sparkSession.createDataFrame(list(quotas.items()), "stratum string, target int")
    have = sample.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("actual"))
    return want.join(have, "stratum", "left").fillna(0, ["actual"])


def non_overlapping(df: DataFrame, key: str, stratum: str, quotas: dict[str, int], seed: int) -> DataFrame:
    return assert_unique(stratified(df, key, stratum, quotas, seed), [key], "the sample")


def memberships(df: DataFrame, key: str, strata: dict[str, Column], n: int, seed: int, forced: list[str] = ()) -> DataFrame:
    """(key, strata): ``n`` of each overlapping stratum, with the names of all that picked a key, and forced keys."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in strata.items()]))
    long = df.select(key, F.explode(labels).alias("stratum"))
    picked = stratified(long, key, "stratum", dict.fromkeys(strata, n), seed).select(key, "stratum")
    if forced:
        picked = picked.union(df.where(F.col(key).isin(list(forced))).select(key, F.lit("forced").alias("stratum")))
    return picked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("stratum")), "|").alias("strata"))


def exclusive(df: DataFrame, key: str, strata: list[tuple[str, Column, int]], seed: int, least: int = 0, forced: list[str] = ()) -> DataFrame:
    """(key, stratum): strata in order, each from what the earlier ones left; forced keys first; filled by hash to ``least``."""
    taken = df.where(F.col(key).isin(list(forced))).select(key, F.lit("forced").alias("stratum"))
    for name, condition, n in strata:
        rest = df.where(condition).join(taken.select(key), key, "left_anti").withColumn("__s", F.lit(name))
        taken = taken.union(stratified(rest, key, "__s", {name: n}, seed).select(key, F.col("__s").alias("stratum")))
    have = taken.count()
    if have < least:
        rest = df.join(taken.select(key), key, "left_anti").withColumn("__s", F.lit("fill"))
        taken = taken.union(stratified(rest, key, "__s", {"fill": least - have}, seed).select(key, F.col("__s").alias("stratum")))
    return taken


def budgeted_quotas(sizes: dict[str, int], cap: int, budget: int) -> dict[str, int]:
    """Quotas of at most ``cap`` and a group's size, shrunk from the largest (of equal ones the last name) until within budget; every group keeps one."""
    quotas = {g: min(n, cap) for g, n in sizes.items() if n}
    while sum(quotas.values()) > budget:
        g = max(quotas, key=lambda k: (quotas[k], k))
        if quotas[g] <= 1:
            raise ContractError("the budget is smaller than the number of groups")
        quotas[g] -= 1
    return quotas


def budgeted(df: DataFrame, key: str, group: str, cap: int, budget: int, seed: int) -> DataFrame:
    sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}  # a row a group
    return stratified(df, key, group, budgeted_quotas(sizes, cap, budget), seed)


def merged_actions(df: DataFrame, key: str, action: str, precedence: list[str]) -> DataFrame:
    """One row a key: the action that comes first in ``precedence``."""
    rank = reduce(lambda acc, kv: F.when(F.col(action) == kv[1], F.lit(kv[0])).otherwise(acc), enumerate(precedence), F.lit(len(precedence)))
    return df.groupBy(key).agg(F.min_by(action, F.struct(rank, F.col(action))).alias(action))


def extremes(df: DataFrame, key: str, metric: str, k: int, middle: int, seed: int) -> DataFrame:
    """The ``k`` highest and lowest rows and ``middle`` others by hash, with ``pick``."""
    rows = df.where(F.col(metric).isNotNull())
    high = rows.orderBy(F.desc(metric), key).limit(k).withColumn("pick", F.lit("high"))
    low = rows.join(high.select(key), key, "left_anti").orderBy(metric, key).limit(k).withColumn("pick", F.lit("low"))
    rest = rows.join(high.select(key).union(low.select(key)), key, "left_anti")
    mid = rest.withColumn("__h", draw(key, F.lit("middle"), seed)).orderBy("__h", key).limit(middle).drop("__h").withColumn("pick", F.lit("middle"))
    return high.unionByName(low.select(*high.columns)).unionByName(mid.select(*high.columns))


def head_per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def first_pure_chunk(df: DataFrame, chunk: str, group: str, size: int) -> DataFrame:
    """(group, chunk): the first chunk of each group that has exactly ``size`` members, all of that group."""
    c = df.groupBy(chunk).agg(F.count("*").alias("n"), F.count_distinct(group).alias("g"), F.min(group).alias(group)).where((F.col("n") == size) & (F.col("g") == 1))
    return c.groupBy(group).agg(F.min(chunk).alias(chunk))


def batches(df: DataFrame, group: str, value: str, most_items: int, most_chars: int, sep: str = " OR ") -> DataFrame:
    """(group, batch, n_items, query): each group's sorted distinct strings, packed in order under two limits; see ``ordered.batched``.

    A string longer than the limit is an error.
    """
    return batched(df, group, value, most_items, most_chars, sep)


def batch_artifacts(names: DataFrame, entity: str, value: str, most_items: int, most_chars: int, sep: str = " OR ") -> tuple[DataFrame, DataFrame]:
    """(batches, name map): all names in one order, and each (entity, name) with the number of entities that share it, its attribution and its batch."""
    shared = names.where(F.col(value).isNotNull()).select(entity, value).distinct()
    n = shared.groupBy(value).agg(F.count("*").alias("n_entities"))
    made = written(batched(names.withColumn("__g", F.lit("all")), "__g", value, most_items, most_chars, sep).drop("group"))
    inside = made.select("batch", F.explode(_parts("query", sep)).alias(value))
    mapped = shared.join(n, value).withColumn("attribution", F.when(F.col("n_entities") > 1, F.lit("collision")).otherwise(F.lit("unique")))
    return made, mapped.join(inside, value, "left")


def _parts(query: str, sep: str) -> Column:
    return F.split(query, f"\\Q{sep}\\E")


def assert_batches_cover(made: DataFrame, names: DataFrame, value: str, sep: str = " OR ") -> None:
    """Every distinct name must be in exactly one batch."""
    inside = made.select(F.explode(_parts("query", sep)).alias(value))
    assert_unique(inside, [value], "the batches")
    lack = names.select(value).where(F.col(value).isNotNull()).distinct().join(inside, value, "left_anti").limit(1).count()
    if lack:
        raise ContractError("a name is in no batch")
