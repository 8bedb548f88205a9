"""Queries over evidence: resolved panels, changes, event rosters, second tiers, provenance and classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit import sources
from panelkit.operators import evidence, sampling
from panelkit.plans.queries import query

_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority, o_orderstatus AS tier FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("tier")
    )


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, date, old, new): from each order's priority to the next one's, one row a customer and date."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = _orders(spark, d).select("o_custkey", F.col("o_orderdate").alias("date"), F.col("priority").alias("new"), F.lag("priority").over(w).alias("old")).where("old is not null")
    return e.groupBy("o_custkey", "date").agg(F.min("old").alias("old"), F.max("new").alias("new"))


_CHANGES = f"""{_ORDERS}, l AS (SELECT o_custkey, o_orderdate AS date, priority AS new, lag(priority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM o),
c AS (SELECT o_custkey, date, min(old) AS old, max(new) AS new FROM l WHERE old IS NOT NULL GROUP BY 1, 2)"""


# -- panels from several kinds of evidence ---------------------------------------------------------


@query(f"""WITH {_CHANGES}, p AS (SELECT DISTINCT o_custkey, year FROM o),
k AS (SELECT o_custkey, year, CASE tier WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS t, min(tier) AS tier, min(priority) AS lo, max(priority) AS hi FROM o GROUP BY 1, 2, 3),
s AS (SELECT o_custkey, year, arg_min(CASE WHEN lo = hi THEN lo ELSE 'none' END, t) AS snap, arg_min(tier, t) AS tier, min(lo) <> max(hi) AS disagree FROM k GROUP BY 1, 2),
a AS (SELECT p.o_custkey, p.year, coalesce(arg_max(c.new, c.date) FILTER (WHERE year(c.date) <= p.year), CASE WHEN count(c.date) FILTER (WHERE year(c.date) <= p.year) = 0 THEN arg_min(c.old, c.date) END) AS ev
  FROM p LEFT JOIN c USING (o_custkey) GROUP BY 1, 2),
j AS (SELECT o_custkey, year, nullif(snap, 'none') AS snapshot, tier, disagree, ev AS event_value, coalesce(ev <> nullif(snap, 'none'), false) AS differ FROM s JOIN a USING (o_custkey, year)),
x AS (SELECT j.*, EXISTS (SELECT 1 FROM c WHERE c.o_custkey = j.o_custkey AND c.new = j.snapshot AND year(c.date) > j.year) AS explained FROM j)
SELECT o_custkey, year, snapshot, event_value, differ OR disagree AS conflict,
  CASE WHEN NOT (differ AND NOT explained) THEN coalesce(event_value, snapshot) END AS priority,
  CASE WHEN differ AND NOT explained THEN 'conflict' WHEN event_value IS NOT NULL THEN 'event' WHEN snapshot IS NOT NULL THEN tier END AS source,
  CASE WHEN NOT (differ AND NOT explained) AND coalesce(event_value, snapshot) IS NOT NULL THEN 'historical' WHEN differ OR disagree THEN 'conflict' ELSE 'static_only' END AS status FROM x""")
def resolved_priorities(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    target = o.select("o_custkey", "year").distinct().withColumn("static", F.lit("3-MEDIUM"))
    out = evidence.resolved_panel(target, o.select("o_custkey", "year", "priority", "tier"), _changes(spark, d), "o_custkey", "year", "priority", "tier", ["F", "O", "P"], "static")
    return out.drop("static")


@query(f"""WITH {_CHANGES}, s AS (SELECT o_custkey, date, CASE WHEN old = '3-MEDIUM' THEN '5-LOW' ELSE old END AS old, CASE WHEN new = '3-MEDIUM' THEN '5-LOW' ELSE new END AS new FROM c)
SELECT DISTINCT o_custkey, CAST(date AS DATE) AS date, old, new FROM s WHERE old <> new""")
def priority_changes(spark: SparkSession, d: str) -> DataFrame:
    c = _changes(spark, d).withColumn("today", F.lit("5-LOW"))
    return evidence.change_table(c, "o_custkey", "date", "old", "new", "3-MEDIUM", "today").withColumn("date", F.col("date").cast("date"))


@query(f"""WITH {_ORDERS}, t AS (SELECT DISTINCT o_custkey, year FROM o), x AS (SELECT o_custkey, year, arg_max(priority, o_orderkey) AS priority FROM o WHERE tier <> 'F' GROUP BY 1, 2)
SELECT t.o_custkey, t.year, x.priority, CASE WHEN x.priority IS NULL THEN 'absent' ELSE 'observed' END AS coverage FROM t LEFT JOIN x USING (o_custkey, year)""")
def open_order_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    return evidence.year_coverage(o.select("o_custkey", "year").distinct(), o.where("tier <> 'F'"), "o_custkey", "year", "priority", "o_orderkey")


# -- events: any shared evidence makes rows one event ----------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, event_id // 3 AS a, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS dt, CAST(year(ts) AS INTEGER) AS y FROM events WHERE event_id % 5 <> 0),
v AS (SELECT user_id, event_type, a, dt, y, row_number() OVER (ORDER BY user_id, event_type, a, dt, y) AS id FROM e),
ev AS (SELECT id, user_id, event_type, 'a' || a AS k FROM v UNION ALL SELECT id, user_id, event_type, CASE WHEN dt IS NULL THEN 'y' || y ELSE 'd' || dt END FROM v),
w AS (SELECT DISTINCT p.id, q.id AS other FROM ev p JOIN ev q USING (user_id, event_type, k)),
reach AS (SELECT id, id AS other FROM v UNION SELECT r.id, w.other FROM reach r JOIN w ON r.other = w.id),
c AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
SELECT user_id, event_type, count(*) AS n_rows, CASE WHEN count(DISTINCT dt) = 1 THEN min(dt) END AS date, count(DISTINCT dt) > 1 AS conflict FROM v JOIN c USING (id) GROUP BY user_id, event_type, c""")
def user_event_roster(spark: SparkSession, d: str) -> DataFrame:
    e = sources.table(spark, d, "events").select(
        "user_id", "event_type", F.col("event_type").alias("kind"), F.expr("event_id div 3").alias("a"), F.when(F.col("event_id") % 4 != 0, F.to_date("ts")).alias("date_"), F.year("ts").alias("y"), "event_id"
    )
    out = evidence.event_roster(e, "user_id", "event_type", "kind", "a", "date_", "y", F.col("event_id") % 5 != 0)
    return out.select("user_id", "event_type", "n_rows", "date", "conflict")


# -- what a second tier has to settle --------------------------------------------------------------


@query(f"""WITH {_ORDERS}, y AS (SELECT o_custkey, year, min(priority) AS name FROM o GROUP BY 1, 2), p AS (SELECT a.o_custkey, a.year, b.name AS previous, a.name AS current FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.year = b.year + 1)
SELECT * FROM p WHERE previous <> current AND NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = p.o_custkey AND o.year = p.year AND o.tier = 'P')""")
def second_tier_cases(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    yearly = o.groupBy("o_custkey", "year").agg(F.min("priority").alias("name"))
    return evidence.needs_second_tier(yearly, "o_custkey", "year", "name", o.where("tier = 'P'"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN 'checked ' || c_mktsegment ELSE '' END AS note FROM customer""")
def carried_notes(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    review = c.select("c_custkey", "c_nationkey", F.lit("").alias("note"))
    prior = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("c_nationkey"), F.concat(F.lit("checked "), "c_mktsegment").alias("note"))
    return evidence.carried_annotations(review, prior, ["c_custkey"], ["c_nationkey"], ["note"]).select("c_custkey", "note")


@query(f"""WITH {_ORDERS} SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE tier END, o_orderkey) AS tier FROM o GROUP BY 1""")
def upserted_orders(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).select("o_custkey", "o_orderkey", "tier")
    return evidence.upserted(o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0").withColumn("tier", F.lit("new")), ["o_custkey"], "o_orderkey")


@query("""WITH c AS (SELECT c_custkey AS canonical, c_nationkey AS co, c_mktsegment AS cn FROM customer)
SELECT c_custkey AS alias, c_custkey + 1 AS canonical, coalesce(c_nationkey = co, false) AS same_org, coalesce(c_mktsegment = cn, false) AS same_name FROM customer LEFT JOIN c ON c_custkey + 1 = c.canonical""")
def neighbouring_customers(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer")
    return evidence.alias_evidence(c, c.select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") + 1).alias("canonical")), "c_custkey", "c_nationkey", "c_mktsegment")


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unmapped' WHEN page_id % 5 = 0 THEN 'content_missing' WHEN page_id % 3 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS status,
  CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN sha256(html) END AS sha256 FROM pages""")
def page_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = sources.table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), F.sha2("html", 256).alias("sha256"))
    manifest = p.where("page_id % 7 <> 0").withColumn("sha256", F.when(F.col("page_id") % 3 != 0, F.col("sha256")).otherwise(F.lit("0")))
    return evidence.provenance(p, manifest, p.where("page_id % 5 <> 0").select("url", "sha256"), ["page_id"], "url", "sha256").select("page_id", "status", "sha256")


# -- classes ---------------------------------------------------------------------------------------

_GAPS = """g AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fetch_failed' WHEN 1 THEN 'not_found' WHEN 2 THEN 'extraction_failed' ELSE 'done' END AS status, user_id % 2 AS chars, CASE WHEN event_id % 9 = 0 THEN '403' ELSE '200' END AS http, event_type = 'error' AS changed FROM events),
f AS (SELECT event_id, CASE WHEN http = '403' THEN 'blocked' WHEN status = 'fetch_failed' THEN 'fetch_failed' WHEN status = 'not_found' AND changed THEN 'not_found_after_change' WHEN status = 'not_found' THEN 'not_found'
  WHEN status = 'extraction_failed' AND chars = 0 THEN 'text_empty' WHEN status = 'extraction_failed' THEN 'extraction_failed' ELSE 'other' END AS gap_family FROM g)"""


@query(f"""WITH {_GAPS} SELECT gap_family, CASE gap_family WHEN 'blocked' THEN 'wait' WHEN 'fetch_failed' THEN 'retry' WHEN 'not_found_after_change' THEN 'search_former_name' WHEN 'not_found' THEN 'search_index'
  WHEN 'text_empty' THEN 'ocr' WHEN 'extraction_failed' THEN 'review' ELSE 'inspect' END AS action, count(*) AS n FROM f GROUP BY 1, 2""")
def event_gap_actions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    status = F.when(k == 0, "fetch_failed").when(k == 1, "not_found").when(k == 2, "extraction_failed").otherwise("done")
    e = sources.table(spark, d, "events").select(
        status.alias("status"), (F.col("user_id") % 2).cast("string").alias("chars"), F.when(F.col("event_id") % 9 == 0, "403").otherwise("200").alias("http"), (F.col("event_type") == "error").alias("changed")
    )
    return evidence.gap_actions(e, "status", "chars", "http", "changed").groupBy("gap_family", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {_ORDERS} SELECT o_custkey, max(priority) FILTER (WHERE k = 1) AS last_value, max(year) AS last_year, array_to_string(list_sort(list(DISTINCT priority)), ',') AS values FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC, priority DESC) AS k FROM o) GROUP BY o_custkey""")
def last_known_priority(spark: SparkSession, d: str) -> DataFrame:
    return evidence.last_known(_orders(spark, d), "o_custkey", "year", "priority").withColumn("values", F.array_join("values", ","))


@query("""SELECT CASE WHEN value > 400 THEN 'large' WHEN event_type = 'error' THEN 'error' ELSE 'other' END AS reason, count(*) AS n, count(DISTINCT user_id) AS n_entities FROM events GROUP BY 1""")
def event_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    e = sources.table(spark, d, "events").select("user_id", "event_type", "value")
    return evidence.diagnosis(e, [("large", F.col("value") > 400), ("error", F.col("event_type") == "error")], "user_id")


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN CASE min(l_returnflag) WHEN 'R' THEN 'resend' WHEN 'N' THEN 'keep' ELSE 'targeted' END ELSE 'targeted' END AS mode FROM lineitem GROUP BY 1""")
def order_repair_mode(spark: SparkSession, d: str) -> DataFrame:
    return evidence.repair_mode(sources.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", {"R": "resend", "N": "keep"})


@query(f"""WITH {_ORDERS}, n AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE tier = 'P') AS e, count(o_orderkey) FILTER (WHERE priority = '1-URGENT') AS x, count(o_orderkey) AS q, count(o_orderkey) FILTER (WHERE tier = 'F') AS b FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN e > 0 THEN 'RESOLVED' WHEN x > 0 THEN 'NOTICE_UNPARSED' WHEN q > 0 AND b = q THEN 'REQUEST_FAILED' WHEN q > 0 THEN 'NO_NOTICE' ELSE 'NOT_REQUESTED' END AS terminal FROM n""")
def customer_forensics(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    targets = sources.table(spark, d, "customer").select("c_custkey")
    return evidence.target_forensics(targets, ["c_custkey"], o.where("tier = 'P'"), o.where("priority = '1-URGENT'"), o, F.col("tier") == "F").select("c_custkey", "terminal")


@query("""WITH p AS (SELECT doc_id, toxic, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 END AS a, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN toxic ELSE doc_id % 2 END END AS b FROM labels)
SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN 'no_prediction' WHEN a = toxic AND b = toxic THEN 'right' WHEN b = toxic THEN 'fixed_by_second' WHEN a = toxic THEN 'broken_by_second' ELSE 'wrong_in_both' END AS class FROM p""")
def label_decomposition(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels")
    first = labels.where("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 2).alias("p"))
    second = labels.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("toxic").cast("long")).otherwise(F.col("doc_id") % 2).alias("p"))
    return evidence.failure_decomposition(labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")), first, second, ["doc_id"], "p", "toxic")


@query("""SELECT count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS n_both, count_if(a.doc_id IS NULL OR b.doc_id IS NULL) AS n_one, coalesce(bool_and(toxic IS NOT DISTINCT FROM t) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL), true) AS agree
FROM (SELECT * FROM labels WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id, toxic AS t FROM labels WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels")
    return evidence.truths_agree(labels.where("doc_id % 2 = 0"), labels.where("doc_id % 3 = 0"), ["doc_id"], "toxic", "toxic")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN 200 + 101 * (event_id % 4) END AS s, props FROM events)
SELECT CASE WHEN s IS NULL THEN 'no_response' WHEN s IN (401, 403, 429) THEN 'blocked' WHEN s IN (404, 410) THEN 'not_found' WHEN s >= 500 THEN 'server_error' WHEN coalesce(trim(props), '') = '' THEN 'empty' ELSE 'ok' END AS response, count(*) AS n FROM x GROUP BY 1""")
def response_classes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 6 != 0, 200 + 101 * (F.col("event_id") % 4))
    e = sources.table(spark, d, "events").select(evidence.response_class(status, F.col("props")).alias("response"))
    return e.groupBy("response").agg(F.count("*").alias("n"))


# -- samples ---------------------------------------------------------------------------------------


@query(f"""WITH {_ORDERS}, k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM o) SELECT o_custkey, o_orderkey FROM k WHERE k <= 2""")
def first_orders(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head_per_group(_orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")
