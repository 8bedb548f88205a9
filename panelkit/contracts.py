"""Contracts that a table must meet before an operator relies on it.

A check is one aggregate or an anti-join whose answer is a count; rows reach the driver only as a few
examples for the message of a failure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks what an operator requires of it."""


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """``df``, if it has all of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, count) of keys that occur more than once; null parts count as values."""
    return df.groupBy(*key).count().where("count > 1")


def assert_unique(df: DataFrame, key: list[str], name: str = "table") -> DataFrame:
    """``df``, if ``key`` is unique and without nulls."""
    require_columns(df, key, name)
    nulls = df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])).limit(1).count()
    if nulls:
        raise ContractError(f"{name} has nulls in its key {key}")
    found = duplicate_keys(df, key).limit(3).collect()
    if found:
        raise ContractError(f"{name} repeats keys: {[tuple(r)[:-1] for r in found]}")
    return df


#: What two sides of a join can break: of each a condition over a key's rows on the left (l) and on the right (r), and what it means.
_JOIN_RULES = {
    "left_unique": (lambda l, r, null: (l > 1) | (null & (l > 0)), "the left side repeats keys or has nulls in them"),
    "right_unique": (lambda l, r, null: (r > 1) | (null & (r > 0)), "the right side repeats keys or has nulls in them"),
    "right_within_left": (lambda l, r, null: (r > 0) & ((l == 0) | null), "the right side has keys that the left has not"),
    "left_within_right": (lambda l, r, null: (l > 0) & ((r == 0) | null), "rows without a match"),
}


def assert_join(left: DataFrame, right: DataFrame, key: list[str], rules: list[str], name: str = "join") -> None:
    """All of ``rules`` (left_unique, right_unique, right_within_left, left_within_right) in one job that reads each side's keys once.

    Rows are counted by key, in tasks before the shuffle; what reaches the driver is a count and one example a rule.
    """
    require_columns(left, key, f"the left side of the {name}")
    require_columns(right, key, f"the right side of the {name}")
    sides = [df.select(*key, F.lit(int(n == 0)).alias("__l"), F.lit(n).alias("__r")) for n, df in enumerate((left, right))]
    counts = sides[0].union(sides[1]).groupBy(*key).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    found = {k: _JOIN_RULES[k][0](F.col("__l"), F.col("__r"), null) for k in rules}
    row = counts.agg(*[x for k, c in found.items() for x in (F.count_if(c).alias(k), F.min(F.when(c, F.struct(*key))).alias(f"{k}_key"))]).first()
    bad = [f"{_JOIN_RULES[k][1]}: {row[k]}, as {tuple(row[f'{k}_key'])}" for k in rules if row[k]]
    if bad:
        raise ContractError(f"{name}: " + "; ".join(bad))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows meet each rule, which names what must not be; one pass over ``df``."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def assert_none(df: DataFrame, rules: dict[str, Column], name: str = "table") -> DataFrame:
    """``df``, if no row meets any rule."""
    bad = [(r["rule"], r["n"]) for r in violations(df, rules).collect() if r["n"]]
    if bad:
        raise ContractError(f"{name} breaks: " + ", ".join(f"{k} ({n} rows)" for k, n in bad))
    return df


def assert_integral(df: DataFrame, column: str, name: str = "table") -> DataFrame:
    """``df`` with ``column`` as long; a value that is no whole number is an error, not a truncation."""
    x = F.expr(f"try_cast(`{column}` as double)")
    assert_none(df, {f"{column} not a whole number": F.col(column).isNotNull() & (x.isNull() | (x % 1 != 0))}, name)
    return df.withColumn(column, x.cast("long"))


def key_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys in one side only, with ``change``: removed (only left) or added (only right)."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("added")))


def assert_same_keys(left: DataFrame, right: DataFrame, key: list[str], allowed_removals: DataFrame | None = None) -> None:
    """Both sides must have the same keys, but for removals that are allowed; keys in addition never are."""
    diff = key_differences(left, right, key)
    if allowed_removals is not None:
        allowed = allowed_removals.select(*key).distinct().withColumn("change", F.lit("removed"))
        diff = diff.join(allowed, [*key, "change"], "left_anti")
    found = diff.limit(3).collect()
    if found:
        raise ContractError(f"keys differ: {[tuple(r) for r in found]}")


def assert_subset(df: DataFrame, scope: DataFrame, key: list[str], name: str = "table") -> DataFrame:
    """``df``, if each of its keys occurs in ``scope``."""
    found = df.join(scope.select(*key).distinct(), key, "left_anti").select(*key).limit(3).collect()
    if found:
        raise ContractError(f"{name} has keys out of scope: {[tuple(r) for r in found]}")
    return df


def assert_partition(whole: DataFrame, parts: list[DataFrame], key: list[str]) -> None:
    """Parts must be disjoint and together have exactly the keys of ``whole``."""
    union = reduce(DataFrame.unionByName, [p.select(*key).distinct() for p in parts])
    assert_unique(union, key, "the union of parts")
    assert_same_keys(whole, union, key)


def assert_within(df: DataFrame, column: str, values: list[str], name: str = "table") -> DataFrame:
    """``df``, if ``column`` holds only ``values`` and no null."""
    return assert_none(df, {f"{column} out of its set": ~F.coalesce(F.col(column).isin(values), F.lit(False))}, name)


def structural_errors(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(columns of ``df``, error): one row for each rule that a row breaks.

    ``unique`` names errors for keys that must not repeat; they are counted once and joined back, so a key
    that a third of all rows share needs no window over them.
    """
    flags = dict(rules)
    for label, key in (unique or {}).items():
        n = f"__n_{label}"
        again = df.groupBy(*key).agg(F.count("*").alias(n)).where(F.col(n) > 1)
        df = df.join(again, key, "left")
        flags[label] = F.col(n).isNotNull()
    errors = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    keep = [c for c in df.columns if not c.startswith("__n_")]
    return df.select(*keep, F.explode(errors).alias("error"))


def review_complete(df: DataFrame, columns: list[str], open_values: tuple[str, ...] = ("", "PENDING", "UNRESOLVED")) -> Column:
    """Whether all rows have each of ``columns`` filled in with something final; for ``df.agg``."""
    done = [F.coalesce(~F.upper(F.trim(F.col(c).cast("string"))).isin(list(open_values)), F.lit(False)) for c in columns]
    return F.bool_and(reduce(lambda a, b: a & b, done))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, checksum, total) that no order of rows or partitions changes; null and empty differ."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("checksum"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("total"))


def exact_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the SHA-256 of all rows, sorted and joined: for small tables, as it gathers them in one task."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("sha256"))
