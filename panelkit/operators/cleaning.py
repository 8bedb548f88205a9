"""Projections, dirty-value handling and de-duplication under explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit.contracts import assert_none, assert_unique, require_columns

# -- columns ---------------------------------------------------------------------------------------


def first_of(df: DataFrame, aliases: dict[str, list[str]], types: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns, each from the first of its aliases that ``df`` has; an absent one is null."""
    out = []
    for name, options in aliases.items():
        found = next((c for c in options if c in df.columns), None)
        kind = (types or {}).get(name, "string")
        out.append((F.col(found) if found else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def resolve_column(columns: list[str], exact: list[str], contains: list[str] = ()) -> tuple[str | None, str]:
    """(column, status): one exact candidate, else one column that contains all terms.

    status is exact, contains, ambiguous or missing; the last two come without a column.
    """
    hits = [c for c in columns if c in exact]
    if not hits and contains:
        hits, how = [c for c in columns if all(t in c for t in contains)], "contains"
    else:
        how = "exact"
    return (hits[0], how) if len(hits) == 1 else (None, "ambiguous" if hits else "missing")


def column_inventory(df: DataFrame, targets: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(column, non_null, target, status) of every column; one pass."""
    match = {}
    for target, (exact, contains) in targets.items():
        found, how = resolve_column(df.columns, exact, contains)
        if found:
            match[found] = (target, how)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "non_null")
    target = reduce(lambda acc, kv: F.when(F.col("column") == kv[0], F.lit(kv[1][0])).otherwise(acc), match.items(), F.lit(None).cast("string"))
    status = reduce(lambda acc, kv: F.when(F.col("column") == kv[0], F.lit(kv[1][1])).otherwise(acc), match.items(), F.lit("unmatched"))
    return counts.select("column", "non_null", target.alias("target"), status.alias("status"))


def mapped(df: DataFrame, column: str, mapping: DataFrame, strict: bool = False, name: str = "value") -> DataFrame:
    """``df`` with ``column`` replaced through ``mapping`` (alias, canonical); unmapped is null, or an error if ``strict``."""
    assert_unique(mapping, ["alias"], "mapping")
    out = df.join(mapping.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c")), F.trim(column) == F.col("__a"), "left").drop("__a")
    if strict:
        assert_none(out, {f"unmapped {name}": F.col(column).isNotNull() & F.col("__c").isNull()}, name)
    return out.withColumn(column, F.col("__c")).drop("__c")


def change_log(df: DataFrame, key: list[str], raw: str, clean: str) -> DataFrame:
    """Rows whose value a normalisation changed."""
    return df.where(~F.col(raw).eqNullSafe(F.col(clean))).select(*key, F.col(raw).alias("before"), F.col(clean).alias("after"))


def sentinels_to_null(df: DataFrame, key: list[str], sentinels: dict[str, list[float]]) -> tuple[DataFrame, DataFrame]:
    """``df`` without known sentinel values, and a log (key, variable, original, action) of what was taken out."""
    hit = {c: F.col(c).isin(v) for c, v in sentinels.items()}
    logged = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("original"))) for c, h in hit.items()]))
    log = df.select(*key, F.explode(logged).alias("x")).select(*key, "x.variable", "x.original", F.lit("set to null").alias("action"))
    return df.withColumns({c: F.when(~F.coalesce(h, F.lit(False)), F.col(c)) for c, h in hit.items()}), log


def without(df: DataFrame, excluded: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not on an exclusion list."""
    return df.join(excluded.select(*key).distinct(), key, "left_anti")


def period_end(df: DataFrame, date: str, years: tuple[int, int]) -> DataFrame:
    """Rows of the last day of a year in a range, with that year."""
    d = F.col(date).cast("date")
    return df.where((F.month(d) == 12) & (F.dayofmonth(d) == 31) & F.year(d).between(*years)).withColumn("year", F.year(d))


def exactly_one(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row a key: its values if it has exactly one row, else nulls; ``ambiguous`` says that it had more."""
    one = F.count("*") == 1
    return df.groupBy(*key).agg(*[F.when(one, F.first(c)).alias(c) for c in values], (F.count("*") > 1).alias("ambiguous"))


def statement_rows(skeleton: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]], key: list[str]) -> DataFrame:
    """Skeleton rows with the values of several sources, a flag ``has_<source>`` for each and a ``failure_reason``.

    A source contributes where it has exactly one row of a key. Reasons are ``<source>_missing`` and
    ``<source>_ambiguous``, joined by ``;``, and null where all went well.
    """
    out, reasons = skeleton, []
    for name, (df, values) in sources.items():
        one = exactly_one(df, key, values).withColumnRenamed("ambiguous", f"__amb_{name}")
        out = out.join(one, key, "left")
        amb = F.col(f"__amb_{name}")
        out = out.withColumn(f"has_{name}", F.coalesce(~amb, F.lit(False)))
        reasons += [F.when(amb.isNull(), F.lit(f"{name}_missing")), F.when(amb, F.lit(f"{name}_ambiguous"))]
    joined = F.array_join(F.array_compact(F.array(*reasons)), ";")
    out = out.withColumn("failure_reason", F.nullif(joined, F.lit("")))
    return out.drop(*[f"__amb_{n}" for n in sources])


def agreed(a: Column, b: Column) -> tuple[Column, Column]:
    """(value, conflict): what two sources agree on or one has alone; null where they differ."""
    conflict = F.coalesce(a != b, F.lit(False))
    return F.when(~conflict, F.coalesce(a, b)), conflict


# -- derived variables -----------------------------------------------------------------------------


def derived(df: DataFrame, ratios: dict[str, tuple[str, str]], logs: dict[str, str], masked_by: str | None = None, masked: list[str] = ()) -> DataFrame:
    """Ratios with positive denominators and logs of positive values; ``masked`` ones only where a record is present."""
    out = df.withColumns({k: fn.safe_ratio(F.col(n), F.col(d)) for k, (n, d) in ratios.items()} | {k: fn.safe_log(F.col(x)) for k, x in logs.items()})
    if masked_by:
        out = out.withColumns({c: F.when(F.col(masked_by) == 1, F.col(c)) for c in masked})
    return out


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return assert_none(df, {f"{c} infinite": F.abs(F.col(c)) == F.lit(float("inf")) for c in columns})


# -- duplicates ------------------------------------------------------------------------------------


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """A hash in which null is a value of its own."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(c).isNull(), F.col(c))])


def distinct_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with each row once, and one row with n_rows, n_distinct and n_removed; nulls are values.

    Equal rows are combined in tasks before the shuffle, so a row that a third of the table repeats costs no more than others.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    log = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_removed", F.col("n_rows") - F.col("n_distinct"))
    return counted.drop("__n"), log


def duplicate_classes(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_rows, kind) of keys with several rows: ``exact`` if all are alike, else ``conflict``."""
    rest = [c for c in df.columns if c not in key]
    h = row_hash(df, rest)
    found = df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(h).alias("lo"), F.max(h).alias("hi")).where("n_rows > 1")
    return found.select(*key, "n_rows", F.when(F.col("lo") == F.col("hi"), F.lit("exact")).otherwise(F.lit("conflict")).alias("kind"))


def pick(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under an order; equal rows in that order are told apart by all columns."""
    names = df.columns
    ties = row_hash(df, names)
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*order, ties))
    return df.withColumn("__r", best).where("__r = 1").select(*names)


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return pick(df, key, [F.col(order).asc_nulls_last()])


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` of each key; partly combined before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("__o"), row_hash(df, rest).alias("__h"), F.struct(*rest).alias("__row"))).alias("t"))
    return top.select(*key, "t.__row.*").select(*df.columns)


def keep_fullest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of exact copies one, of conflicting rows the one with fewest nulls; the earliest in ``order`` of equal ones."""
    rest = [c for c in df.columns if c not in (*key, order)]
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in rest])
    return pick(df, key, [nulls, F.col(order)])


def keep_consistent(df: DataFrame, key: list[str], stored: str, recomputed: Column, tolerance: float = 1e-4) -> DataFrame:
    """Of a key's rows the one whose stored value fits the recomputed one; exactly one must."""
    ok = F.coalesce(F.abs(F.col(stored) - recomputed) <= tolerance, F.lit(False))
    many = df.groupBy(*key).agg(F.count("*").alias("__n"), F.count_if(ok).alias("__ok"))
    joined = df.withColumn("__fit", ok).join(many, key)
    assert_none(joined, {"no single consistent row": (F.col("__n") > 1) & (F.col("__ok") != 1)}, "conflicting keys")
    return joined.where("__n = 1 or __fit").select(*df.columns)


def best_record(df: DataFrame, key: list[str], url: str, ident: str, date: str) -> DataFrame:
    """The best record of each key: with an https url, with an id, then the latest date, then the greatest url."""
    order = [F.coalesce(F.col(url).startswith("https://"), F.lit(False)).desc(), F.col(ident).isNotNull().desc(), F.col(date).desc_nulls_last(), F.col(url).desc_nulls_last()]
    return pick(df, key, order)


def upper_bound(df: DataFrame, column: str, mads: float = 10.0, iqrs: float = 3.0) -> DataFrame:
    """One row with ``bound``: median + ``mads`` * MAD; if the MAD is 0, Q3 + ``iqrs`` * IQR; null below 3 values or without spread."""
    x = F.col(column)
    first = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.median(x).alias("m"), F.percentile(x, [0.25, 0.75]).alias("q"))
    spread = df.where(x.isNotNull()).join(F.broadcast(first)).agg(F.median(F.abs(x - F.col("m"))).alias("mad"))  # one row
    both = first.join(F.broadcast(spread))
    iqr = F.col("q")[1] - F.col("q")[0]
    bound = F.when(F.col("mad") > 0, F.col("m") + mads * F.col("mad")).when(iqr > 0, F.col("q")[1] + iqrs * iqr)
    return both.select(F.when(F.col("n") >= 3, bound).alias("bound"))


def outliers_to_null(df: DataFrame, column: str) -> DataFrame:
    """``df`` with values above ``upper_bound`` as null and a flag ``<column>_outlier``."""
    joined = df.join(F.broadcast(upper_bound(df, column)))  # one row
    out = F.coalesce(F.col(column) > F.col("bound"), F.lit(False))
    return joined.withColumn(f"{column}_outlier", out).withColumn(column, F.when(~F.col(f"{column}_outlier"), F.col(column))).drop("bound")


def recovered_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with missing keys filled from a name that belongs to exactly one key and whose key has exactly one name."""
    known = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, name).distinct()
    by_name = known.groupBy(name).agg(F.count("*").alias("a"), F.min(key).alias("__k")).where("a = 1")
    by_key = known.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("b")).where("b = 1")
    unique = by_name.join(by_key, "__k").select(F.col(name), "__k")
    return df.join(unique, name, "left").withColumn(key, F.coalesce(F.col(key), F.col("__k"))).select(*df.columns)


def inconsistent_keys(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, column names that vary) of keys that are not consistent."""
    varies = [F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) > 1, F.lit(c)) for c in columns]
    return df.groupBy(*key).agg(F.array_compact(F.array(*varies)).alias("varies")).where(F.size("varies") > 0)


def assert_consistent(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    require_columns(df, [*key, *columns])
    found = inconsistent_keys(df, key, columns).limit(3).collect()
    if found:
        from panelkit.contracts import ContractError

        raise ContractError(f"values vary within keys: {[tuple(r) for r in found]}")
    return df
