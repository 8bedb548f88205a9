"""Joins with validated cardinality, set algebra on keys, intervals and periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.contracts import ContractError, assert_join, assert_none, assert_subset, assert_unique, exact_fingerprint, fingerprint, key_differences, require_columns
from panelkit.operators.ordered import cumulated, row_numbers, running_max  # noqa: F401  cumulated is used from here

# -- joins -----------------------------------------------------------------------------------------


def lookup(left: DataFrame, right: DataFrame, key: list[str], require_match: bool = True) -> DataFrame:
    """Many-to-one left join: ``key`` must be unique on the right, and every left row must match unless told otherwise."""
    assert_join(left, right, key, ["right_unique", *(["left_within_right"] if require_match else [])], "lookup")
    return left.join(right, key, "left")


def with_record(skeleton: DataFrame, records: DataFrame, key: list[str], flag: str = "record_present", checked: bool = True) -> DataFrame:
    """One-to-one left join onto a skeleton with a 0/1 flag of presence; absent values stay null, never zero.

    ``checked`` asserts that the key is unique on both sides and that no record lies outside the skeleton.
    """
    if checked:
        assert_join(skeleton, records, key, ["left_unique", "right_unique", "right_within_left"], "skeleton and records")
    out = skeleton.join(records.withColumn("__m", F.lit(1)), key, "left")
    return out.withColumn(flag, F.coalesce("__m", F.lit(0))).drop("__m")


def aligned(left: DataFrame, right: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Full outer join on ``key`` with both sides' values suffixed and flags ``in_left`` and ``in_right``."""
    assert_join(left, right, key, ["left_unique", "right_unique"], "alignment")
    a = left.select(*key, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in key], F.lit(True).alias("in_left"))
    b = right.select(*key, *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in key], F.lit(True).alias("in_right"))
    return a.join(b, key, "full").fillna(False, ["in_left", "in_right"])


def joined_reviews(predictions: DataFrame, reviews: DataFrame, provenance: DataFrame, key: list[str]) -> DataFrame:
    """Predictions with their reviews and provenance, each one-to-one; shared column names get a suffix."""
    out = predictions
    for df, suffix in ((reviews, "_review"), (provenance, "_source")):
        assert_join(out, df, key, ["left_unique", "right_unique"], f"predictions and {suffix[1:]}")
        taken = set(out.columns) - set(key)
        df = df.select(*key, *[F.col(c).alias(c + suffix if c in taken else c) for c in df.columns if c not in key])
        out = out.join(df, key, "left")
    return out


def key_report(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a new version removes, adds or changes, with ``change``; columns of both must be the same."""
    rest = [c for c in old.columns if c not in key]
    changed_keys = key_differences(old, new, key)
    gone = old.join(changed_keys.where("change = 'removed'"), key)
    came = new.select(*old.columns).join(changed_keys.where("change = 'added'"), key)
    differs = reduce(lambda a, b: a | b, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rest])
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    changed = old.alias("a").join(new.alias("b"), on).where(differs).select(*[F.col(f"b.{c}").alias(c) for c in old.columns], F.lit("changed").alias("change"))
    return gone.select(*old.columns, "change").unionByName(came.select(*old.columns, "change")).unionByName(changed)


def replace_rows(base: DataFrame, replacements: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of the replacements' keys exchanged; each of those keys must exist, and once."""
    assert_unique(replacements, key, "the replacements")
    assert_subset(replacements, base, key, "the replacements")
    return base.join(replacements.select(*key), key, "left_anti").unionByName(replacements, allowMissingColumns=True)


def assert_only_replaced(before: DataFrame, after: DataFrame, replaced: DataFrame, key: list[str]) -> None:
    """Proves by fingerprints that rows of other keys are as before."""
    parts = [fingerprint(d.join(replaced.select(*key).distinct(), key, "left_anti"), before.columns).first() for d in (before, after)]
    if parts[0] != parts[1]:
        raise ContractError("rows outside the replaced keys changed")


def filled_from(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``left`` with empty or null values of ``columns`` taken from ``right``; existing values win."""
    assert_unique(right, key, "the right side")
    r = right.select(*key, *[F.col(c).alias(f"__r_{c}") for c in columns])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__r_{c}")) for c in columns}
    return left.join(r, key, "left").withColumns(filled).select(*left.columns)


def complete_grid(df: DataFrame, entities: DataFrame, periods: list[int], entity: str, period: str, template: dict[str, object]) -> DataFrame:
    """``df`` with a template row for every missing cell of entities times periods."""
    cells = entities.select(entity).distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))
    missing = cells.join(df.select(entity, period), [entity, period], "left_anti")
    rows = missing.withColumns({k: F.lit(v) for k, v in template.items()})
    return df.unionByName(rows, allowMissingColumns=True)


def grid_coverage(df: DataFrame, entities: DataFrame, periods: list[int], entity: str, period: str) -> DataFrame:
    """One row: expected, available and missing cells of entities times periods."""
    cells = entities.select(entity).distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))
    seen = df.select(entity, period).distinct().withColumn("__m", F.lit(1))
    return cells.join(seen, [entity, period], "left").agg(F.count("*").alias("expected"), F.count("__m").alias("available"), F.count_if(F.col("__m").isNull()).alias("missing"))


def either_code(df: DataFrame, mapping: DataFrame, code: str, old: str, new: str) -> DataFrame:
    """(code, candidates): sorted codes that a mapping connects with each code, itself included; two equi-joins for the OR."""
    pairs = mapping.select(F.col(old).alias(code), F.col(new).alias("c")).union(mapping.select(F.col(new).alias(code), F.col(old).alias("c")))
    own = df.select(code).distinct()
    hits = own.join(pairs, code).union(own.select(code, F.col(code).alias("c")))
    return hits.groupBy(code).agg(F.array_sort(F.collect_set("c")).alias("candidates"))


def previous(df: DataFrame, entity: str, period: str, columns: list[str], suffix: str = "_previous") -> DataFrame:
    """``df`` with values of the entity's row one period before; null unless there is exactly one such row."""
    one = df.groupBy(entity, period).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"{c}{suffix}") for c in columns]).where("__n = 1").drop("__n")
    return df.join(one.withColumn(period, F.col(period) + 1), [entity, period], "left")


def events_to_rows(rows: DataFrame, events: DataFrame, entity: str, period: str, event_id: str, name: str, old: str, new: str) -> DataFrame:
    """``rows`` with ``event_id``: of the same entity and period, else the one event of the entity with the row's name as old or new."""
    exact = events.groupBy(entity, period).agg(F.count("*").alias("n"), F.min(event_id).alias("__exact")).where("n = 1").drop("n")
    both = events.select(entity, event_id, F.explode(F.array_distinct(F.array(old, new))).alias(name)).where(F.col(name).isNotNull())
    named = both.groupBy(entity, name).agg(F.count_distinct(event_id).alias("n"), F.min(event_id).alias("__named")).where("n = 1").drop("n")
    out = rows.join(exact, [entity, period], "left").join(named, [entity, name], "left")
    return out.withColumn(event_id, F.coalesce("__exact", "__named")).drop("__exact", "__named")


def first_complete(candidates: DataFrame, key: list[str], complete: str, order: str) -> DataFrame:
    """The first complete candidate of each key in ``order``; without one, the last that was tried."""
    rank = [F.col(complete).desc(), F.when(F.col(complete), F.col(order)).otherwise(-F.col(order))]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*rank))
    return candidates.withColumn("__r", best).where("__r = 1").drop("__r")


def with_boundary(stage: DataFrame, earlier: DataFrame, period: str) -> DataFrame:
    """A stage's rows with the earlier rows of the period just before its first, for comparisons across the boundary."""
    first = stage.agg(F.min(period).alias("__first"))  # one row
    before = earlier.join(F.broadcast(first), F.col(period) == F.col("__first") - 1).drop("__first")
    return stage.withColumn("is_boundary", F.lit(False)).unionByName(before.withColumn("is_boundary", F.lit(True)), allowMissingColumns=True)


def aligned_union(pieces: dict[str, DataFrame], piece: str = "piece") -> DataFrame:
    """All rows of several tables with the name of theirs in ``piece``; a column that a table lacks is null there, of the type it has elsewhere.

    Types that differ between tables must be numbers, which become the widest of them; others are a ContractError, not a cast.
    """
    kinds: dict[str, set[str]] = {}
    for df in pieces.values():
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    widest = ("double", "float", "bigint", "int", "smallint", "tinyint")
    types = {}
    for name, found in kinds.items():
        if len(found) > 1 and not found <= set(widest):
            raise ContractError(f"{name} is {' and '.join(sorted(found))}")
        types[name] = next((k for k in widest if k in found), None) or next(iter(found))
    parts = [df.select(F.lit(k).alias(piece), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]) for k, df in pieces.items()]
    return reduce(DataFrame.unionByName, parts)


def restricted(df: DataFrame, scope: DataFrame, key: list[str]) -> DataFrame:
    return df.join(scope.select(*key).distinct(), key, "left_semi")


def refresh_manifest(manifest: DataFrame, universe: DataFrame, key: list[str], reason: str, year: str) -> tuple[DataFrame, str]:
    """A checked manifest and its fingerprint: filled keys and reasons, whole years, unique, within the universe."""
    require_columns(manifest, [*key, reason, year])
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in (*key, reason)])
    y = F.expr(f"try_cast(`{year}` as double)")
    assert_none(manifest, {"blank": blank, "year": y.isNull() | (y % 1 != 0)}, "the manifest")
    assert_unique(manifest, key, "the manifest")
    assert_subset(manifest, universe, key, "the manifest")
    return manifest, exact_fingerprint(manifest, [*key, reason]).first()[0]


def reconciled(tables: dict[str, tuple[DataFrame, DataFrame]], key: list[str], removals: DataFrame) -> DataFrame:
    """(table, removed, added, unexpected) for before and after versions of tables: all must lose only ``removals``."""
    out = []
    for name, (old, new) in tables.items():
        diff = key_differences(old, new, key).join(removals.select(*key).distinct().withColumn("__ok", F.lit(1)), key, "left")
        removed = F.col("change") == "removed"
        out.append(diff.agg(F.lit(name).alias("table"), F.count_if(removed).alias("removed"), F.count_if(~removed).alias("added"), F.count_if(~removed | F.col("__ok").isNull()).alias("unexpected")))
    return reduce(DataFrame.unionByName, out)


def review_table(predictions: DataFrame, key: list[str], review_columns: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The reviewers' table: the existing one if its keys are those of the predictions, else blank rows."""
    if existing is not None:
        diff = key_differences(predictions, existing, key).limit(1).count()
        if diff:
            raise ContractError("the review's keys differ from the predictions'")
        return existing
    return predictions.select(*key).withColumns({c: F.lit("") for c in review_columns})


def set_relations(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: sizes of A and B, of both and of the union, and whether they are disjoint, A within B, and equal."""
    x = a.select(*key).distinct().withColumn("__a", F.lit(1))
    y = b.select(*key).distinct().withColumn("__b", F.lit(1))
    n = x.join(y, key, "full").agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count("*").alias("n_union"))
    return n.withColumns({"disjoint": F.col("n_both") == 0, "a_within_b": F.col("n_both") == F.col("n_a"), "equal": (F.col("n_both") == F.col("n_a")) & (F.col("n_a") == F.col("n_b"))})


# -- intervals and periods -------------------------------------------------------------------------


def market_start(listing: Column, start: str) -> Column:
    """The later of a listing and the market's start; a null listing is the start."""
    return F.greatest(listing.cast("date"), F.lit(start).cast("date"))


def expand_years(df: DataFrame, begin: str, end: str, first: int, last: int, excluded: Column | None = None) -> DataFrame:
    """A row for each year in which an entity is listed: begun by its last day, and not ended by its first.

    An open end lasts; a null begin gives no row. ``excluded`` is a condition over ``df`` and ``year``.
    """
    b, e = F.col(begin).cast("date"), F.col(end).cast("date")
    # An end on January 1 is not a day of that year.
    until = F.coalesce(F.year(F.date_sub(e, 1)), F.lit(last))
    lo, hi = F.greatest(F.lit(first), F.year(b)), F.least(F.lit(last), until)
    out = df.where(b.isNotNull()).withColumn("year", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    return out.where(~excluded) if excluded is not None else out


def illegal_periods(df: DataFrame, year: str, begin: str, end: str) -> Column:
    """Whether a year lies before the begin's or after the end's."""
    y = F.col(year)
    return F.coalesce(y < F.year(F.col(begin).cast("date")), F.lit(False)) | F.coalesce(y > F.year(F.col(end).cast("date")), F.lit(False))


def as_of(periods: DataFrame, events: DataFrame, entity: str, year: str, date: str, old: str, new: str, name: str) -> DataFrame:
    """``periods`` with the value that dated events imply at each year's end.

    The last event by then gives its new value; if all come later, the earliest gives its old one; without
    a dated event it is null. Of events of one day the greater value counts.
    """
    d = F.col(date).cast("date")
    e = events.where(d.isNotNull()).select(entity, d.alias("__d"), F.col(old).alias("__old"), F.col(new).alias("__new"))
    on = periods.select(entity, year).distinct().join(e, entity)
    past = F.col("__d") <= F.make_date(F.col(year), F.lit(12), F.lit(31))
    found = on.groupBy(entity, year).agg(
        F.max(F.when(past, F.struct("__d", "__new"))).alias("__last"),
        F.min(F.struct("__d", "__old")).alias("__first"),
    )
    value = F.when(F.col("__last").isNotNull(), F.col("__last.__new")).otherwise(F.col("__first.__old"))
    return periods.join(found.select(entity, year, value.alias(name)), [entity, year], "left")


def overlapping(df: DataFrame, group: list[str], ident: str, begin: str, end: str) -> DataFrame:
    """(group, has_overlap): whether any two intervals of a group meet; ends belong to them, a null end is open.

    Sorted by begin, an interval meets an earlier one if it begins by the latest end so far: no pairs, and no
    task that holds a group.
    """
    spans = df.select(*group, ident, F.col(begin).cast("date").alias("__begin"), F.coalesce(F.col(end).cast("date"), F.lit("9999-12-31").cast("date")).alias("__end"))
    seen = running_max(spans, group, ["__begin", ident], "__end", "__latest")
    meets = F.coalesce(F.col("__begin") <= F.col("__latest"), F.lit(False))
    return seen.groupBy(*group).agg(F.bool_or(meets).alias("has_overlap"))


def event_timing(date: Column, precision: Column, year: Column) -> Column:
    """PRE_YEAR, IN_YEAR, POST_YEAR, YEAR_PRECISION, NO_DATE or UNPARSEABLE of a date relative to a year."""
    t = F.trim(date)
    d = F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit("NO_DATE"))
        .when((precision == "year") | t.rlike("^[0-9]{4}$"), F.lit("YEAR_PRECISION"))
        .when(d.isNull(), F.lit("UNPARSEABLE"))
        .when(F.year(d) < year, F.lit("PRE_YEAR"))
        .when(F.year(d) > year, F.lit("POST_YEAR"))
        .otherwise(F.lit("IN_YEAR"))
    )


def boundary_year(year: Column, begin: Column, end: Column) -> Column:
    """Whether an entity begins or ends in the year or the one before."""
    years = F.array(year, year - 1)
    return F.coalesce(F.array_contains(years, F.year(begin.cast("date"))), F.lit(False)) | F.coalesce(F.array_contains(years, F.year(end.cast("date"))), F.lit(False))


def in_notice_window(url: Column, year: Column, pattern: str = r"/([0-9]{4}-[0-9]{2}-[0-9]{2})/") -> Column:
    """Whether the date in a URL's path lies from January 1 of the year to March 31 of the next."""
    d = F.try_to_date(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), "yyyy-MM-dd")
    return d.between(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year + 1, F.lit(3), F.lit(31)))


def group_lag(members: DataFrame, group: str, period: str, value: str, name: str) -> DataFrame:
    """``members`` with the group's value one row earlier, found on the table of distinct group periods.

    A lag over the member rows would meet the same period again.
    """
    table = members.select(group, period, value).distinct()
    assert_unique(table, [group, period], "group periods")
    lagged = table.withColumn(name, F.lag(value).over(Window.partitionBy(group).orderBy(period))).select(group, period, name)
    return members.join(lagged, [group, period], "left")


# -- windows ---------------------------------------------------------------------------------------


def differenced(df: DataFrame, entity: str, period: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(period)
    return df.withColumns({f"{c}_diff": F.col(c) - F.lag(c).over(w) for c in columns})


def discontinuities(df: DataFrame, entity: str, period: str, value: Column) -> DataFrame:
    """``df`` with ``changed_from_previous`` and ``changed_at_all``: values of adjacent periods that differ, on the later row and on both."""
    w = Window.partitionBy(entity).orderBy(period)
    v = F.col("__v")
    out = df.withColumn("__v", value)
    back = (F.col(period) == F.lag(period).over(w) + 1) & (v != F.lag("__v").over(w))
    ahead = (F.col(period) + 1 == F.lead(period).over(w)) & (v != F.lead("__v").over(w))
    later, earlier = F.coalesce(back, F.lit(False)), F.coalesce(ahead, F.lit(False))
    return out.withColumn("changed_from_previous", later).withColumn("changed_at_all", later | earlier).drop("__v")


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with chunk_id and chunk_position, both from 1, in a global order."""
    n = F.col("__n") - 1
    return row_numbers(df, order, "__n").withColumn("chunk_id", F.floor(n / size) + 1).withColumn("chunk_position", n % size + 1).drop("__n")


def target_manifest(universe: DataFrame, entity: str, period: str, attributes: list[str], size: int) -> DataFrame:
    """One row an entity: attributes, first and last period and their number, and its chunk."""
    out = universe.groupBy(entity).agg(*[F.max_by(c, period).alias(c) for c in attributes], F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count_distinct(period).alias("n_periods"))
    return chunks(out, [entity], size)
