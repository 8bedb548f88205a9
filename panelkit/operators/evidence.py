"""Resolution of tiered and dated evidence, entity names, and rule-based classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit.contracts import ContractError, assert_none, assert_partition, assert_same_keys, assert_unique, assert_within
from panelkit.operators.cleaning import keep_last
from panelkit.operators.graph import components
from panelkit.operators.panel import as_of, overlapping, previous
from panelkit.operators.text import review_code
from panelkit.sources import written

# -- evidence --------------------------------------------------------------------------------------


def preferred(df: DataFrame, key: list[str], tier: str, value: str, order: list[str]) -> DataFrame:
    """(key, value, tier, n_values, conflict): the value of the best tier.

    ``order`` lists tiers from best to worst. Disagreement inside the best tier leaves the value null; any
    disagreement is a conflict. Null values are no evidence.
    """
    rank = reduce(lambda acc, kv: F.when(F.col(tier) == kv[1], F.lit(kv[0])).otherwise(acc), enumerate(order), F.lit(len(order)))
    rows = df.where(F.col(value).isNotNull()).withColumn("__t", rank)
    # One row a key and tier, so the second step never gathers a key's rows.
    each = rows.groupBy(*key, "__t").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(tier).alias(tier))
    top = each.groupBy(*key).agg(F.min(F.struct("__t", "lo", "hi", tier)).alias("b"), F.min("lo").alias("l"), F.max("hi").alias("h"))
    return top.select(*key, F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias(value), F.col(f"b.{tier}").alias(tier), (F.col("l") != F.col("h")).alias("conflict"))


def static_status(value: Column, year: Column, current: int) -> Column:
    """What a value of today says of a year: never history."""
    return F.when(value.isNull(), F.lit("missing")).when(year == current, F.lit("static_current")).otherwise(F.lit("static_only"))


def resolved_panel(target: DataFrame, snapshots: DataFrame, events: DataFrame, entity: str, year: str, value: str, tier: str, order: list[str], static: str) -> DataFrame:
    """One row a target (entity, year): the value, where it came from, and whether evidence disagreed.

    Snapshots (entity, year, value, tier) give the best tier's value; events (entity, date, old, new) the
    value at the year's end. The event wins. Where both exist and differ, the event counts if an event
    dated after the year explains the snapshot (it was the new value by then); else the value is null and a conflict.
    Without either the static value sets only ``status``.
    """
    assert_unique(target, [entity, year], "the target")
    snap = preferred(snapshots, [entity, year], tier, value, order).withColumnRenamed(value, "snapshot").withColumnRenamed("conflict", "snapshot_conflict")
    out = as_of(target.join(snap, [entity, year], "left"), events, entity, year, "date", "old", "new", "event_value")
    later = events.select(entity, F.col("date").cast("date").alias("__d"), F.col("new").alias("snapshot"))
    explained = out.select(entity, year, "snapshot").join(later, [entity, "snapshot"]).where(F.year("__d") > F.col(year)).select(entity, year).distinct().withColumn("__x", F.lit(True))
    out = out.join(explained, [entity, year], "left")
    differ = F.col("event_value").isNotNull() & F.col("snapshot").isNotNull() & (F.col("event_value") != F.col("snapshot"))
    unresolved = differ & F.col("__x").isNull()
    resolved = F.when(~F.coalesce(unresolved, F.lit(False)), F.coalesce("event_value", "snapshot"))
    source = F.when(unresolved, F.lit("conflict")).when(F.col("event_value").isNotNull(), F.lit("event")).when(F.col("snapshot").isNotNull(), F.col(tier))
    conflict = F.coalesce(F.col("snapshot_conflict"), F.lit(False)) | F.coalesce(differ, F.lit(False))
    status = F.when(resolved.isNotNull(), F.lit("historical")).when(conflict, F.lit("conflict")).when(F.col(static).isNotNull(), F.lit("static_only")).otherwise(F.lit("missing"))
    return out.select(*target.columns, resolved.alias(value), source.alias("source"), conflict.alias("conflict"), status.alias("status"), "snapshot", "event_value")


def conflicts(panel: DataFrame, key: list[str]) -> DataFrame:
    return panel.where("conflict").select(*key, "snapshot", "event_value", "status")


def change_table(df: DataFrame, entity: str, date: str, old: str, new: str, placeholder: str | None = None, current: str | None = None) -> DataFrame:
    """Distinct changes with old and new known and different; a placeholder for today's value is replaced by it."""
    a, b = F.col(old), F.col(new)
    if placeholder and current:
        a, b = (F.when(x == placeholder, F.col(current)).otherwise(x) for x in (a, b))
    return df.select(entity, date, a.alias(old), b.alias(new)).where(F.col(old) != F.col(new)).distinct()


# -- names -----------------------------------------------------------------------------------------


def name_universe(profiles: DataFrame, entity: str, current: str, former: str, reviews: DataFrame) -> DataFrame:
    """(entity, name, field, status, eligible): current and former names exploded, with reviewed evidence applied.

    ``reviews`` is (entity, name, status, valid_from, valid_to), one row an (entity, name key). Names that only a
    review knows are added. An unreviewed former name is unresolved and no query is made of it.
    """
    cur = profiles.select(entity, F.col(current).alias("name"), F.lit("current").alias("field"))
    old = profiles.select(entity, fn.folded(F.coalesce(F.col(former), F.lit(""))).alias("__f")).select(entity, F.explode(fn.split_names(F.col("__f"))).alias("name"), F.lit("former").alias("field"))
    names = cur.union(old).where("name is not null").withColumn("name_key", fn.identity_key(F.col("name")))
    rank = F.when(F.col("field") == "current", 0).otherwise(1)
    names = names.groupBy(entity, "name_key").agg(F.min(F.struct(rank.alias("r"), "name", "field")).alias("b")).select(entity, "name_key", "b.name", "b.field")
    rev = reviews.select(entity, fn.identity_key(F.col("name")).alias("name_key"), F.col("name").alias("__n"), F.col("status").alias("__s"), "valid_from", "valid_to")
    assert_unique(rev, [entity, "name_key"], "the reviews")
    out = names.join(rev, [entity, "name_key"], "full")
    status = F.coalesce("__s", F.when(F.col("field") == "current", F.lit("current")).otherwise(F.lit("unresolved")))
    out = out.select(entity, "name_key", F.coalesce("name", "__n").alias("name"), F.coalesce("field", F.lit("review")).alias("field"), status.alias("status"), "valid_from", "valid_to")
    return out.withColumn("eligible", F.col("status").isin("current", "verified"))


def year_coverage(target: DataFrame, records: DataFrame, entity: str, year: str, value: str, stamp: str) -> DataFrame:
    """Target rows with the latest record's value of that very year; no record leaves it null with status absent."""
    latest = keep_last(records.select(entity, year, value, stamp), [entity, year], stamp).select(entity, year, value)
    return target.join(latest, [entity, year], "left").withColumn("coverage", F.when(F.col(value).isNotNull(), F.lit("observed")).otherwise(F.lit("absent")))


def collisions(names: DataFrame, entity: str, name_key: str, org: str, security: str) -> DataFrame:
    """(collision_id, name_key, n_entities, n_orgs, n_securities, kind): names of two entities or more.

    One organisation with several securities is a shared_entity, all else unresolved.
    """
    n = names.groupBy(name_key).agg(F.count_distinct(entity).alias("n_entities"), F.count_distinct(org).alias("n_orgs"), F.count_distinct(security).alias("n_securities")).where("n_entities > 1")
    kind = F.when((F.col("n_orgs") == 1) & (F.col("n_securities") > 1), F.lit("shared_entity")).otherwise(F.lit("unresolved"))
    return n.select(fn.short_id("COL-", [F.col(name_key)], 16).alias("collision_id"), name_key, "n_entities", "n_orgs", "n_securities", kind.alias("kind"))


def collision_details(found: DataFrame, names: DataFrame, entity: str, name_key: str, begin: str, end: str) -> DataFrame:
    """Collisions with their members as sorted JSON and whether any two members' intervals meet."""
    members = names.join(found.select(name_key), name_key, "left_semi")
    detail = members.groupBy(name_key).agg(F.to_json(F.array_sort(F.collect_set(F.struct(entity, begin, end)))).alias("details"))
    return found.join(detail, name_key).join(overlapping(members, [name_key], entity, begin, end), name_key)


# -- events ----------------------------------------------------------------------------------------


def event_rows(df: DataFrame, entity: str, old: str, new: str, announcement: str, date: str, year: str, official: Column, source: str | None = None) -> DataFrame:
    """(entity, old, new, announcement, date, year, source, label): distinct official rows with the event they belong to.

    Rows of an (entity, old, new) belong together if they share an announcement, an exact date, or a year without a
    date: with ``source``, a column, a year of the same announcement or, where that is null, of the same source. Events
    are the components of that relation, found by contraction in a number of rounds that grows with the logarithm of the longest chain.
    """
    named = [entity, old, new, announcement, date, year, *([source] if source else [])]
    block = [entity, old, new]
    rows = df.where(official).select(*named).distinct()
    rows = written(rows.withColumn("__id", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in named])))
    text = F.concat(F.lit("y:"), F.col(year).cast("string"))
    if source:
        text = F.concat(text, F.lit("|"), F.coalesce(F.col(announcement).cast("string"), F.col(source).cast("string")))
    shared = F.array_compact(F.array(F.concat(F.lit("a:"), F.col(announcement).cast("string")), F.concat(F.lit("d:"), F.col(date).cast("string")), F.when(F.col(date).isNull(), text)))
    edges = rows.withColumn("ev", F.explode(shared)).select("__id", F.xxhash64(*block, "ev").alias("e"))
    labels = components(edges, "__id", "e").select(F.col("node").alias("__id"), F.col("component").alias("label"))
    # A row without any evidence is an event of its own.
    return rows.join(labels, "__id", "left").select(*named, F.coalesce("label", "__id").alias("label"))


def event_roster(df: DataFrame, entity: str, old: str, new: str, announcement: str, date: str, year: str, official: Column, source: str | None = None) -> DataFrame:
    """(entity, old, new, event_id, n_rows, date, conflict): one row for each event of ``event_rows``.

    An event with more than one exact date is a conflict and has no date.
    """
    block = [entity, old, new]
    rows = event_rows(df, entity, old, new, announcement, date, year, official, source)
    out = rows.groupBy(*block, "label").agg(F.count("*").alias("n_rows"), F.count_distinct(date).alias("n_dates"), F.min(date).alias("d"), F.min(F.coalesce(F.col(announcement).cast("string"), F.lit(""))).alias("a"), F.min(F.col(year)).alias("y"))
    ident = fn.short_id("EVT-", [F.col(c).cast("string") for c in (*block, "a", "d", "y")])
    return out.select(*block, ident.alias("event_id"), "n_rows", F.when(F.col("n_dates") == 1, F.col("d")).alias("date"), (F.col("n_dates") > 1).alias("conflict"))


def change_candidates(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Rows that some signal marks, with the names of those that do."""
    return df.withColumn("reasons", fn.flag_list(signals, none="")).where("reasons <> ''")


def needs_second_tier(predictions: DataFrame, entity: str, year: str, name: str, resolved: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(entity, year, previous, current): adjacent rows whose names differ and that no resolved record covers; legacy cases added."""
    p = previous(predictions.select(entity, year, name), entity, year, [name])
    need = p.where(fn.identity_key(F.col(name)) != fn.identity_key(F.col(f"{name}_previous"))).select(entity, year, F.col(f"{name}_previous").alias("previous"), F.col(name).alias("current"))
    if legacy is not None:
        need = need.unionByName(legacy.select(*need.columns).join(need.select(entity, year), [entity, year], "left_anti"))
    return need.join(resolved.select(entity, year).distinct(), [entity, year], "left_anti")


def fused(rows: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` overwritten where an update of the key has a value; a key has one update at most."""
    assert_unique(updates, key, "the updates")
    u = updates.select(*key, *[F.col(c).alias(f"__u_{c}") for c in columns])
    return rows.join(u, key, "left").withColumns({c: F.coalesce(f"__u_{c}", c) for c in columns}).select(*rows.columns)


def complete_predictions(keys: DataFrame, predictions: DataFrame, key: list[str], state: str, hidden: str = "review_") -> DataFrame:
    """One row a key; columns of reviews are left out, and a missing state is UNKNOWN."""
    assert_unique(predictions, key, "the predictions")
    p = predictions.select(*[c for c in predictions.columns if not c.startswith(hidden)])
    return keys.select(*key).join(p, key, "left").withColumn(state, F.coalesce(state, F.lit("UNKNOWN")))


def carried_annotations(review: DataFrame, prior: DataFrame, key: list[str], identity: list[str], annotations: list[str]) -> DataFrame:
    """``review`` with prior annotations where all identity columns are as they were."""
    p = prior.select(*key, *[F.col(c).alias(f"__p_{c}") for c in (*identity, *annotations)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in identity])
    return review.join(p, key, "left").withColumns({c: F.when(same, F.col(f"__p_{c}")).otherwise(F.col(c)) for c in annotations}).select(*review.columns)


def upserted(existing: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """The latest row of each key over both."""
    return keep_last(existing.unionByName(new, allowMissingColumns=True), key, stamp)


def alias_evidence(profiles: DataFrame, aliases: DataFrame, entity: str, org: str, name: str) -> DataFrame:
    """(alias, canonical, same_org, same_name) for pairs (alias, canonical) of entities."""
    a = profiles.select(F.col(entity).alias("alias"), F.col(org).alias("ao"), F.col(name).alias("an"))
    c = profiles.select(F.col(entity).alias("canonical"), F.col(org).alias("co"), F.col(name).alias("cn"))
    return aliases.join(a, "alias", "left").join(c, "canonical", "left").select("alias", "canonical", fn.all_equal(F.col("ao"), F.col("co")).alias("same_org"), fn.all_equal(fn.identity_key(F.col("an")), fn.identity_key(F.col("cn"))).alias("same_name"))


def one_source(keys: DataFrame, sources: list[DataFrame], key: list[str], url: str, valid: Column) -> DataFrame:
    """(key, url): the one valid url of each key over several source tables; none or two is an error."""
    rows = reduce(DataFrame.unionByName, [s.where(valid).select(*key, url) for s in sources])
    n = keys.select(*key).join(rows, key, "left").groupBy(*key).agg(F.count_distinct(url).alias("n"), F.min(url).alias(url))
    assert_none(n, {"no source": F.col("n") == 0, "ambiguous source": F.col("n") > 1}, "sources")
    return n.select(*key, url)


def provenance(predictions: DataFrame, manifest: DataFrame, content: DataFrame, key: list[str], url: str, sha: str) -> DataFrame:
    """(key, url, sha256, status) of each prediction: verified, hash_mismatch, content_missing or unmapped."""
    j = predictions.select(*key).join(manifest.select(*key, url, F.col(sha).alias("__want")), key, "left").join(content.select(url, F.col(sha)), url, "left")
    status = review_code([("unmapped", F.col(url).isNull()), ("content_missing", F.col(sha).isNull()), ("hash_mismatch", F.col(sha) != F.col("__want"))], "verified")
    return j.select(*key, url, sha, status.alias("status"))


# -- classes ---------------------------------------------------------------------------------------


def classified(df: DataFrame, name: str, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """``df`` with the first class whose rule holds; a rule that is null doesn't."""
    return df.withColumn(name, review_code([(k, F.coalesce(c, F.lit(False))) for k, c in rules], otherwise))


def mapped_class(x: Column, mapping: dict[str, str], override: Column | None = None, otherwise: str | None = None) -> Column:
    """A class by a mapping of values; where ``override`` has a value, that."""
    out = reduce(lambda acc, kv: F.when(x == kv[0], F.lit(kv[1])).otherwise(acc), mapping.items(), F.lit(otherwise).cast("string"))
    return F.coalesce(override, out) if override is not None else out


def coverage_families(df: DataFrame, key: list[str], family: Column, families: list[str], expected: DataFrame) -> DataFrame:
    """(family, n) of a partition that is checked: each key in one family of the list, and the keys as expected."""
    rows = df.withColumn("family", family)
    assert_within(rows, "family", families)
    assert_same_keys(expected, rows, key)
    assert_partition(expected, [rows.where(F.col("family") == f) for f in families], key)
    return rows.groupBy("family").agg(F.count("*").alias("n"))


def gap_actions(df: DataFrame, status: str, text_chars: str, http_status: str, name_changed: str) -> DataFrame:
    """``df`` with gap_family and proposed action of rows that have no result; nested rules, the first that holds."""
    rules = [
        ("blocked", fn.integer(F.col(http_status)).isin(403, 429)),
        ("fetch_failed", F.col(status) == "fetch_failed"),
        ("not_found_after_change", (F.col(status) == "not_found") & F.col(name_changed)),
        ("not_found", F.col(status) == "not_found"),
        ("text_empty", (F.col(status) == "extraction_failed") & (fn.integer(F.col(text_chars)) == 0)),
        ("extraction_failed", F.col(status) == "extraction_failed"),
    ]
    actions = {"blocked": "wait", "fetch_failed": "retry", "not_found_after_change": "search_former_name", "not_found": "search_index", "text_empty": "ocr", "extraction_failed": "review", "other": "inspect"}
    out = classified(df, "gap_family", rules, "other")
    return out.withColumn("action", mapped_class(F.col("gap_family"), actions))


def stale_risk(revision: Column, current: str, changed: Column, evidence: Column) -> Column:
    """HIGH, MEDIUM, LOW or INSUFFICIENT risk of a result that an older revision made; CURRENT if none."""
    return review_code([("CURRENT", F.coalesce(revision == current, F.lit(False))), ("INSUFFICIENT", evidence.isNull()), ("HIGH", F.coalesce(changed, F.lit(False))), ("MEDIUM", F.coalesce(fn.text(evidence) == "weak", F.lit(False)))], "LOW")


def last_known(df: DataFrame, entity: str, year: str, value: str) -> DataFrame:
    """(entity, last value, last year, all values sorted)."""
    return df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.max_by(value, F.struct(year, value)).alias("last_value"), F.max(year).alias("last_year"), F.array_sort(F.collect_set(value)).alias("values"))


def enriched(rows: DataFrame, lookups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """``rows`` with the columns of several lookup tables, each of which has a key once."""
    out = rows
    for df, key in lookups:
        assert_unique(df, key)
        out = out.join(df, key, "left")
    return out


def diagnosis(df: DataFrame, rules: list[tuple[str, Column]], entity: str) -> DataFrame:
    """(reason, n, n_entities) of unresolved rows by their first reason."""
    return classified(df, "reason", rules, "other").groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct(entity).alias("n_entities"))


def source_identity(official: Column, issuer: Column, year: Column, full: Column, title: Column) -> Column:
    """The class of a source from what is known of it; the first doubt counts."""
    return review_code([("NOT_OFFICIAL", ~official), ("WRONG_ISSUER", ~issuer), ("WRONG_YEAR", ~year), ("SUMMARY", ~full | F.coalesce(title.rlike("(?i)summary|摘要"), F.lit(False)))], "VERIFIED_FULL_REPORT")


def index_result(requested: Column, total: Column, valid: Column, cap: int) -> Column:
    """What an index search shows: candidates, a search cut at the page cap, or none after all pages."""
    return review_code([("FOUND", valid > 0), ("NO_PAGES", F.coalesce(total == 0, F.lit(True))), ("PAGE_CAP", (requested < total) & (requested >= cap)), ("INCOMPLETE", requested < total)], "EXHAUSTED")


def run_status(df: DataFrame, done: Column, expected: int, complete: Column, unchanged: bool) -> DataFrame:
    """One row with two axes: whether the run executed as planned, and what has to follow."""
    m = df.agg(F.count_if(done).alias("n_done"), F.count_if(complete).alias("n_complete"), F.count("*").alias("n"))
    executed = F.when(~F.lit(unchanged), F.lit("INPUTS_CHANGED")).when(F.col("n_done") != expected, F.lit("INCOMPLETE")).otherwise(F.lit("EXECUTED"))
    return m.withColumn("execution", executed).withColumn("follow_up", F.when(F.col("n_complete") == F.col("n"), F.lit("NONE")).otherwise(F.lit("PROVENANCE_REVIEW")))


def diagnostic_outcome(old: Column, new: Column, truth: Column) -> Column:
    """How a new result compares with an old one, given a review."""
    o, n = old.eqNullSafe(truth), new.eqNullSafe(truth)
    return review_code([("NOT_REVIEWED", truth.isNull()), ("CONFIRMED", o & n), ("REPAIRED", ~o & n), ("REGRESSED", o & ~n)], "STILL_WRONG")


def repair_mode(df: DataFrame, group: str, mechanism: str, modes: dict[str, str], mixed: str = "targeted") -> DataFrame:
    """(group, mode): the mode of a group's only mechanism, else the mixed one."""
    one = df.groupBy(group).agg(F.count_distinct(mechanism).alias("n"), F.min(mechanism).alias("m"))
    return one.select(group, F.when(F.col("n") == 1, mapped_class(F.col("m"), modes, otherwise=mixed)).otherwise(F.lit(mixed)).alias("mode"))


def target_forensics(targets: DataFrame, key: list[str], evidence: DataFrame, notices: DataFrame, requests: DataFrame, failed: Column) -> DataFrame:
    """One terminal class a target from how many evidence, notice and request rows it has."""
    out = targets
    for name, df, agg in (("n_evidence", evidence, F.count("*")), ("n_notices", notices, F.count("*")), ("n_requests", requests, F.count("*")), ("n_failed", requests, F.count_if(failed))):
        out = out.join(df.groupBy(*key).agg(agg.alias(name)), key, "left")
    out = out.fillna(0, ["n_evidence", "n_notices", "n_requests", "n_failed"])
    return classified(out, "terminal", [("RESOLVED", F.col("n_evidence") > 0), ("NOTICE_UNPARSED", F.col("n_notices") > 0), ("REQUEST_FAILED", (F.col("n_requests") > 0) & (F.col("n_failed") == F.col("n_requests"))), ("NO_NOTICE", F.col("n_requests") > 0)], "NOT_REQUESTED")


def failure_decomposition(frozen: DataFrame, first: DataFrame, second: DataFrame, key: list[str], value: str, truth: str) -> DataFrame:
    """(key, class): which step of a two-step prediction makes a row right or wrong."""
    a, b = (d.select(*key, F.col(value).alias(n)) for d, n in ((first, "__a"), (second, "__b")))
    j = frozen.join(a, key, "left").join(b, key, "left")
    x, y = F.col("__a").eqNullSafe(F.col(truth)), F.col("__b").eqNullSafe(F.col(truth))
    out = classified(j, "class", [("no_prediction", F.col("__a").isNull() & F.col("__b").isNull()), ("right", x & y), ("fixed_by_second", ~x & y), ("broken_by_second", x & ~y)], "wrong_in_both")
    return out.select(*key, "class")


def event_state(in_year: Column, explicit_none: Column, event_year: Column, sufficient: Column, target: Column) -> Column:
    """YES, NO or UNKNOWN; silence is never NO."""
    return review_code([("YES", F.coalesce(in_year | (event_year == target), F.lit(False))), ("NO", F.coalesce(explicit_none | (sufficient & (event_year != target)), F.lit(False)))], "UNKNOWN")


def truths_agree(a: DataFrame, b: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """One row: rows in both or one of two truth tables, and whether all common ones agree."""
    j = a.select(*key, F.col(x).alias("__a"), F.lit(1).alias("i")).join(b.select(*key, F.col(y).alias("__b"), F.lit(1).alias("j")), key, "full")
    both = F.col("i").isNotNull() & F.col("j").isNotNull()
    return j.agg(F.count_if(both).alias("n_both"), F.count_if(~both).alias("n_one"), F.coalesce(F.bool_and(F.when(both, F.col("__a").eqNullSafe(F.col("__b")))), F.lit(True)).alias("agree"))


def gate_class(metrics: DataFrame, complete: Column, good: Column) -> DataFrame:
    """A one-row metrics table with ``gate``: INCOMPLETE is apart from NEEDS_FIX."""
    return metrics.withColumn("gate", review_code([("INCOMPLETE", ~F.coalesce(complete, F.lit(False))), ("NEEDS_FIX", ~F.coalesce(good, F.lit(False)))], "PASS"))


def patent_type(number: Column, raw: Column) -> Column:
    """design, utility, invention or unknown, from a type's text or else the letter at the end of a publication number."""
    t, n = F.lower(fn.text(raw)), F.upper(fn.text(number))
    return review_code([("design", t.contains("design") | t.contains("外观")), ("utility", t.contains("utility") | t.contains("实用新型")), ("invention", t.contains("invention") | t.contains("发明")), ("design", n.rlike("S$")), ("utility", n.rlike("[UY]$")), ("invention", n.rlike("[AB]$|C$"))], "unknown")


def response_class(status: Column, body: Column, challenge: str = r"(?i)captcha|access denied|verify you are human") -> Column:
    """blocked, challenge, not_found, server_error, empty, ok or no_response."""
    b = fn.text(body)
    return review_code([("no_response", status.isNull()), ("blocked", status.isin(401, 403, 429)), ("not_found", status.isin(404, 410)), ("server_error", status >= 500), ("empty", b == ""), ("challenge", b.rlike(challenge))], "ok")


def acquisition(action: Column, url: Column, stored: Column) -> Column:
    """What to do for a row: reuse what is stored, fetch a known url, or search; nothing else."""
    return review_code([("REUSE", F.coalesce(stored, F.lit(False))), ("FETCH", url.isNotNull() & action.isin("refresh", "fetch"))], "SEARCH")


def frozen_manifest(df: DataFrame, universe: DataFrame, key: list[str], counts: dict[str, int], action: str) -> DataFrame:
    """``df``, if its keys are unique and in the universe and each action has as many rows as it must."""
    assert_unique(df, key, "the manifest")
    out = df.join(universe.select(*key).distinct(), key, "left_anti").limit(1).count()
    have = {r[0]: r[1] for r in df.groupBy(action).count().collect()}  # a row an action
    if out or have != counts:
        raise ContractError(f"the manifest is not as frozen: {have}, {out} row out of scope")
    return df


def ranked_names(names: DataFrame, entity: str, order: list[str]) -> DataFrame:
    return names.withColumn("rank", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


# -- prefixes --------------------------------------------------------------------------------------


def longest_prefix(df: DataFrame, text: str, prefixes: DataFrame, name: str = "label") -> DataFrame:
    """``df`` with the label of the first class of ``prefixes`` (prefix, label, class) that has a prefix of the text, of its longest; null without one.

    Classes go in ascending order; of one prefix with several labels the least counts. Blanks and leading quotes of the text don't
    count. Every distinct text is cut at each length that a prefix has, which is bounded by the longest prefix, and joined by equality,
    so neither side is compared with all of the other, and a text that a third of the rows share is looked up once.
    """
    known = prefixes.where(F.length("prefix") > 0).groupBy("prefix").agg(F.min(F.struct(F.col("class").alias("c"), F.col("label").alias("l"))).alias("__k"))
    lengths = known.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("__lengths"))  # one row
    texts = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    plain = F.regexp_replace(F.regexp_replace("__text", r"\s+", ""), "^[\u201c\u201d\u2018\u2019\"']+", "")
    cuts = texts.join(F.broadcast(lengths)).select("__text", plain.alias("__p"), F.explode("__lengths").alias("__n")).where(F.length("__p") >= F.col("__n"))
    cuts = cuts.select("__text", "__n", F.expr("left(__p, __n)").alias("prefix"))
    best = cuts.join(known, "prefix").groupBy("__text").agg(F.min(F.struct("__k.c", -F.col("__n"), "__k.l")).alias("__best"))
    best = best.select("__text", F.col("__best.l").alias(name))
    return df.join(best, df[text].eqNullSafe(best["__text"]), "left").drop("__text")
