"""Summaries, coverage, failure and accuracy audits, and gates: aggregates with few rows out."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import MISSING, unparsable
from panelkit.sources import written


def describe(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(variable, n, missing, mean, sd, min, p<q>..., max, share_one), one row a column; one pass over long rows."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "x")
    q = F.percentile("x", list(quantiles))
    names = [f"p{round(100 * v)}" for v in quantiles]
    out = long.groupBy("variable").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"), F.avg((F.col("x") == 1).cast("double")).alias("share_one"))
    return out.select("variable", "n", "missing", "mean", "sd", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "max", "share_one")


def missing_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, token, n) of strings that stand for a missing value."""
    long = df.select([F.trim(F.col(c).cast("string")).alias(c) for c in columns]).unpivot([], columns, "column", "token")
    return long.where(F.col("token").isin(list(MISSING))).groupBy("column", "token").agg(F.count("*").alias("n"))


def unparsable_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of values that are no numbers even after cleaning."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.where(unparsable(F.col("value"))).groupBy("column", "value").agg(F.count("*").alias("n"))


def duplicate_audit(df: DataFrame, key: list[str], skeleton: DataFrame) -> DataFrame:
    """One row: rows, exact duplicates, rows and groups with repeated keys, keys, and skeleton cells observed or not."""
    keys = df.groupBy(*key).agg(F.count("*").alias("n"))
    k = keys.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("member_rows"), F.count_if(F.col("n") > 1).alias("groups"), F.count("*").alias("keys"))
    exact = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_duplicates"))
    grid = skeleton.select(*key).distinct().join(keys, key, "left").agg(F.count("n").alias("observed"), F.count_if(F.col("n").isNull()).alias("unobserved"))
    return k.join(F.broadcast(exact)).join(F.broadcast(grid))  # one row each


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) for each pair of columns, on rows complete in that pair; one pass."""
    pairs = list(combinations(columns, 2))
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("r"), F.count_if(both).alias("n")))
    return df.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def average_rank(column: str) -> Column:
    """The mean rank among ties, as an expression over all rows; for frames of bounded size, as a rank orders them in one task."""
    w = Window.orderBy(column)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho, n) on complete pairs.

    Ranks come from counts by value, so what is ordered is one row a distinct value, whatever the ties. Pairs are written
    once: sums of doubles computed again may differ in their last digit, and would not find their ranks by value.
    """
    both = written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")))

    def ranks(c: str) -> DataFrame:
        from panelkit.operators.panel import cumulated

        n = both.groupBy(c).agg(F.count("*").alias("n"))
        return cumulated(n, [c], "n", "upto").select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    return both.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.corr("rank_a", "rank_b").alias("rho"), F.count("*").alias("n"))


def sample_flow(stages: dict[str, DataFrame]) -> DataFrame:
    """(step, stage, n) of how many rows each stage keeps."""
    return reduce(DataFrame.unionByName, [d.agg(F.lit(i).alias("step"), F.lit(k).alias("stage"), F.count("*").alias("n")) for i, (k, d) in enumerate(stages.items(), 1)])


def coverage(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, field, n, denominator, rate): how many rows of a group have each field."""
    out = df.groupBy(*group).agg(F.count("*").alias("denominator"), *[F.count(c).alias(c) for c in columns])
    return out.unpivot([*group, "denominator"], columns, "field", "n").withColumn("rate", F.col("n") / F.col("denominator"))


def complete_coverage(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, n, n_complete, rate): rows that have all of ``columns``."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(whole).alias("n_complete"), F.avg(whole.cast("double")).alias("rate"))


def failures(df: DataFrame, group: list[str], columns: list[str], reason: str, sep: str = ";") -> DataFrame:
    """(group, cause, n, share): missing fields as FIELD_MISSING:<field> and each single reason, over the group's rows."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"FIELD_MISSING:{c}")) for c in columns]))
    given = F.filter(F.transform(F.split(F.coalesce(F.col(reason), F.lit("")), sep), lambda t: F.trim(t)), lambda t: t != "")
    causes = df.select(*group, F.explode(F.concat(missing, given)).alias("cause")).groupBy(*group, "cause").agg(F.count("*").alias("n"))
    if not group:
        return causes.join(F.broadcast(df.agg(F.count("*").alias("t")))).select("cause", "n", (F.col("n") / F.col("t")).alias("share"))  # one row
    total = df.groupBy(*group).agg(F.count("*").alias("t"))
    return causes.join(total, group).select(*group, "cause", "n", (F.col("n") / F.col("t")).alias("share"))


def gate(df: DataFrame, levels: list[str], ok: Column, threshold: float, all_label: str = "ALL") -> DataFrame:
    """(levels, n, n_ok, rate, passed) for each combination of levels and all partial ones, by grouping sets."""
    sets = df.select(*levels, ok.cast("int").alias("__ok")).rollup(*levels)
    out = sets.agg(F.grouping_id().alias("__g"), F.count("*").alias("n"), F.sum("__ok").alias("n_ok"))
    k = len(levels)
    labels = {c: F.when((F.col("__g").bitwiseAND(F.lit(1 << (k - 1 - i)))) != 0, F.lit(all_label)).otherwise(F.col(c)) for i, c in enumerate(levels)}
    return out.withColumns(labels).withColumn("rate", F.col("n_ok") / F.col("n")).withColumn("passed", F.col("rate") >= threshold).drop("__g")


def strata_coverage(df: DataFrame, strata: dict[str, Column], covered: Column) -> DataFrame:
    """(stratum, n, n_covered, rate) where a row may belong to several strata, and to ``all``."""
    labels = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(k)) for k, c in strata.items()]))
    return df.select(F.explode(labels).alias("stratum"), covered.cast("double").alias("c")).groupBy("stratum").agg(F.count("*").alias("n"), F.sum("c").cast("long").alias("n_covered"), F.avg("c").alias("rate"))


def verdict(df: DataFrame, metrics: dict[str, Column], rules: dict[str, Column]) -> DataFrame:
    """One row: the metrics, ``failed`` with the names of rules over them that don't hold, and ``status`` PASS or FAIL."""
    m = df.agg(*[c.alias(k) for k, c in metrics.items()])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return m.withColumn("failed", failed).withColumn("status", F.when(F.size("failed") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")))


def available_in_all(df: DataFrame, group: str, period: str, required: list[int], reference: DataFrame) -> DataFrame:
    """(group, n, in_reference): rows a group, and whether the reference has the group in every required period."""
    have = reference.groupBy(group).agg(F.size(F.array_except(F.array(*[F.lit(p) for p in required]), F.collect_set(period))).alias("lack"))
    return df.groupBy(group).agg(F.count("*").alias("n")).join(have, group, "left").select(group, "n", F.coalesce(F.col("lack") == 0, F.lit(False)).alias("in_reference"))


def means_by_presence(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def content_audit(manifest: DataFrame, content: DataFrame, key: str, payload: str, sha: str, size: str, least: int, token: str | None = None) -> DataFrame:
    """(key, issue): manifest entries whose content is missing, differs in hash or size, is too short, or lacks its token."""
    p = F.col(payload)
    joined = manifest.join(content.select(key, p), key, "left")
    rules = {"missing": p.isNull(), "hash": F.sha2(p, 256) != F.col(sha), "size": F.octet_length(p) != F.col(size), "short": F.octet_length(p) < least}
    if token:
        rules["token"] = ~p.cast("string").contains(F.col(token).cast("string"))
    return joined.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("issue"))


def distribution_json(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group, distribution): counts of a column's values as JSON with sorted keys."""
    n = df.groupBy(*group, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n"))))).alias("distribution"))


def entity_status(df: DataFrame, entity: str, complete: str, failed: str, reason: str, sep: str = ";") -> DataFrame:
    """(entity, status, reasons): COMPLETE if all periods are, QUERY_FAILED if all failed, else PARTIAL; reasons sorted and unique."""
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(F.coalesce(F.col(reason), F.lit("")), sep), lambda t: t != ""))))), sep)
    status = F.when(F.bool_and(complete), F.lit("COMPLETE")).when(F.bool_and(failed), F.lit("QUERY_FAILED")).otherwise(F.lit("PARTIAL"))
    return df.groupBy(entity).agg(status.alias("status"), reasons.alias("reasons"))


def chunk_completeness(manifest: DataFrame, status: DataFrame, chunk: str, entity: str, state: str, terminal: list[str], blocked: list[str]) -> DataFrame:
    """(chunk, members, present, complete): whether all of a chunk's members are there, terminal and unblocked."""
    j = manifest.select(chunk, entity).join(status.select(entity, state), entity, "left")
    ok = F.coalesce(F.col(state).isin(terminal) & ~F.col(state).isin(blocked), F.lit(False))
    return j.groupBy(chunk).agg(F.count("*").alias("members"), F.count(state).alias("present"), F.bool_and(ok).alias("complete"))


def field_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, coverage, infinite, nonpositive)."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "field", "x")
    return long.groupBy("field").agg(F.count("x").alias("n"), F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"), F.count_if(F.abs("x") == F.lit(float("inf"))).alias("infinite"), F.count_if(F.col("x") <= 0).alias("nonpositive"))


def by_period(df: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """(period, metric, n, mean, median, sd)."""
    long = df.select(period, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([period], columns, "metric", "x")
    return long.groupBy(period, "metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("sd"))


def trajectory(df: DataFrame, entity: str, period: str, value: str, periods: list[int]) -> DataFrame:
    """One row an entity and one column a period; the periods are given, so no job finds them."""
    return df.groupBy(entity).pivot(period, periods).agg(F.first(value))


def flag_overlap(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flags, n) for every combination of boolean flags, those that don't occur with 0."""
    cells = df.sparkSession.range(2 ** len(flags)).select(*[(F.shiftright("id", i) % 2 == 1).alias(f) for i, f in enumerate(reversed(flags))][::-1])
    n = df.groupBy(*[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags]).agg(F.count("*").alias("n"))
    return cells.join(n, flags, "left").fillna(0, ["n"])


def confusion(df: DataFrame, predicted: str, truth: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(predicted, truth, *by).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, predicted: str, truth: str, valid: Column) -> DataFrame:
    """One row: rows, valid and excluded ones, correct ones, and accuracy over the valid; nulls are values."""
    right = F.col(predicted).eqNullSafe(F.col(truth))
    return df.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("n_excluded"), F.count_if(valid & right).alias("n_correct")).withColumn("accuracy", F.when(F.col("n_valid") > 0, F.col("n_correct") / F.col("n_valid")))


def cause_summary(df: DataFrame, cause: str, flags: list[str], group: str) -> DataFrame:
    """(cause, n, errors of each flag, groups sorted and joined)."""
    return df.groupBy(cause).agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f"{f}_errors") for f in flags], F.array_join(F.array_sort(F.collect_set(group)), ";").alias("groups"))


def dependency_rollup(tables: dict[str, DataFrame], root: str, key: list[str], event: str, metric: str) -> DataFrame:
    """(root, n_rows, n_events, metrics): distinct keys and events that depend on each root over several tables."""
    parts = [d.select(root, *key, (F.col(event) if event in d.columns else F.lit(None)).cast("string").alias("event"), F.lit(k).alias(metric)) for k, d in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(root).agg(F.count_distinct(F.struct(*key)).alias("n_rows"), F.count_distinct("event").alias("n_events"), F.array_join(F.array_sort(F.collect_set(metric)), ";").alias("metrics"))


def regressions(old: DataFrame, new: DataFrame, key: list[str], correct: str) -> DataFrame:
    """One row: keys right in both, newly wrong and newly right."""
    j = old.select(*key, F.col(correct).alias("o")).join(new.select(*key, F.col(correct).alias("w")), key)
    return j.agg(F.count_if(F.col("o") & F.col("w")).alias("kept"), F.count_if(F.col("o") & ~F.col("w")).alias("lost"), F.count_if(~F.col("o") & F.col("w")).alias("gained"))


def sample_matrix(population: DataFrame, sample: DataFrame, group: list[str], key: list[str], valid: str, reviewed: str) -> DataFrame:
    """(group, population, sampled, valid, reviewed)."""
    p = population.groupBy(*group).agg(F.count("*").alias("population"))
    s = sample.groupBy(*group).agg(F.count("*").alias("sampled"), F.count_if(valid).alias("valid"), F.count_if(reviewed).alias("reviewed"))
    return p.join(s, group, "left").fillna(0, ["sampled", "valid", "reviewed"])


def stale(df: DataFrame, key: list[str], status: str, successes: list[str], revision: str, current: str) -> DataFrame:
    """One row: successes, and those of another revision than the current one."""
    done = F.col(status).isin(successes)
    old = done & ~F.col(revision).eqNullSafe(F.lit(current))
    return df.agg(F.count_distinct(F.when(done, F.struct(*key))).alias("n_success"), F.count_distinct(F.when(old, F.struct(*key))).alias("n_stale"))


def selection_check(manifest: DataFrame, selected: DataFrame, key: list[str], expected: int) -> DataFrame:
    """One row: how many are selected, out of scope, repeated or null, and whether all is as expected."""
    j = selected.select(*key).join(manifest.select(*key).distinct().withColumn("__m", F.lit(1)), key, "left")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    out = j.agg(F.count("*").alias("n"), F.count_if(F.col("__m").isNull()).alias("out_of_scope"), (F.count("*") - F.count_distinct(F.struct(*key))).alias("duplicates"), F.count_if(null).alias("nulls"))
    return out.withColumn("passed", (F.col("n") == expected) & (F.col("out_of_scope") == 0) & (F.col("duplicates") == 0) & (F.col("nulls") == 0))


def canary(df: DataFrame, group: str, sizes: dict[str, int], entity: str, key: list[str], bad: Column, ok: Column, threshold: float = 0.9) -> DataFrame:
    """(group, n_entities, n_rows, duplicates, bad, rate, passed) against the sizes that groups must have."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    out = df.groupBy(group).agg(F.count_distinct(entity).alias("n_entities"), F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(F.struct(*key))).alias("duplicates"), F.count_if(bad).alias("bad"), F.avg(ok.cast("double")).alias("rate"))
    return out.withColumn("passed", (F.col("n_entities") == F.try_element_at(want, F.col(group))) & (F.col("duplicates") == 0) & (F.col("bad") == 0) & (F.col("rate") >= threshold))


def distinct_by_class(df: DataFrame, cls: str, columns: list[str]) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])
