"""Further queries: key sets and replacements, grids, windows, audits, evidence and text metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit import sources
from panelkit.operators import audits, cleaning, evidence, panel, text
from panelkit.plans.queries import _PANEL, customer_years, joined_panel, query, r, returns


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"))


# -- key sets and replacements ---------------------------------------------------------------------


@query(f"""WITH {_PANEL} SELECT coalesce(cy.o_custkey, ret.o_custkey) AS o_custkey, coalesce(cy.year, ret.year) AS year, cy.n_orders AS n_orders_a, ret.n_returned AS n_returned_b,
  cy.o_custkey IS NOT NULL AS in_left, ret.o_custkey IS NOT NULL AS in_right
FROM (SELECT * FROM cy WHERE n_orders > 1) cy FULL JOIN (SELECT * FROM ret WHERE n_returned > 1) ret ON cy.o_custkey = ret.o_custkey AND cy.year = ret.year""")
def aligned_years(spark: SparkSession, d: str) -> DataFrame:
    a = customer_years(spark, d).where("n_orders > 1").select("o_custkey", "year", "n_orders")
    b = returns(spark, d).where("n_returned > 1").select("o_custkey", "year", "n_returned")
    return panel.aligned(a, b, ["o_custkey", "year"], ("_a", "_b"))


@query("""SELECT l.doc_id, l.quality, r.toxic AS quality_review, s.source FROM labels l LEFT JOIN labels r ON l.doc_id = r.doc_id LEFT JOIN documents s ON l.doc_id = s.doc_id""")
def reviewed_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels")
    docs = sources.table(spark, d, "documents").select("doc_id", "source")
    return panel.joined_reviews(labels.select("doc_id", "quality"), labels.select("doc_id", F.col("toxic").alias("quality")), docs, ["doc_id"])


_VERSIONS = """old AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_orderkey % 7 <> 0),
new AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 5 <> 0)"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d)
    return o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 5 <> 0").withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))


@query(f"""WITH {_VERSIONS}
SELECT old.*, 'removed' AS change FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)
UNION ALL SELECT new.*, 'added' FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)
UNION ALL SELECT new.*, 'changed' FROM new JOIN old USING (o_orderkey) WHERE new.price <> old.price""")
def order_changes(spark: SparkSession, d: str) -> DataFrame:
    return panel.key_report(*_versions(spark, d), ["o_orderkey"])


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE CAST(o_totalprice AS DOUBLE) END AS price FROM orders""")
def replaced_orders(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    put = o.where("o_orderkey % 3 = 0").withColumn("price", F.lit(0.0))
    out = panel.replace_rows(o, put, ["o_orderkey"])
    panel.assert_only_replaced(o, out, put, ["o_orderkey"])
    return out


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN n_name ELSE c_mktsegment END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def filled_labels(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer")
    label = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    names = c.join(sources.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("label"))
    return panel.filled_from(c.select("c_custkey", label.alias("label")), names, ["c_custkey"], ["label"])


@query(f"""WITH {_PANEL}, g AS (SELECT c_custkey AS o_custkey, unnest(range(1994, 1998)) AS year FROM customer)
SELECT o_custkey, year, n_orders, 'seen' AS state FROM cy UNION ALL SELECT g.o_custkey, CAST(g.year AS INTEGER), NULL, 'template' FROM g ANTI JOIN cy ON g.o_custkey = cy.o_custkey AND g.year = cy.year""")
def year_grid(spark: SparkSession, d: str) -> DataFrame:
    entities = sources.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    seen = customer_years(spark, d).select("o_custkey", "year", "n_orders").withColumn("state", F.lit("seen"))
    return panel.complete_grid(seen, entities, [1994, 1995, 1996, 1997], "o_custkey", "year", {"state": "template"})


@query(f"""WITH {_PANEL}, g AS (SELECT c_custkey AS o_custkey, unnest(range(1994, 1998)) AS year FROM customer)
SELECT count(*) AS expected, count(cy.year) AS available, count(*) - count(cy.year) AS missing FROM g LEFT JOIN cy ON g.o_custkey = cy.o_custkey AND g.year = cy.year""")
def grid_counts(spark: SparkSession, d: str) -> DataFrame:
    entities = sources.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return panel.grid_coverage(customer_years(spark, d), entities, [1994, 1995, 1996, 1997], "o_custkey", "year")


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem UNION SELECT s_suppkey, s_suppkey FROM supplier)
SELECT s_suppkey AS code, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS candidates FROM supplier JOIN p ON a = s_suppkey GROUP BY 1""")
def code_candidates(spark: SparkSession, d: str) -> DataFrame:
    codes = sources.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("code"))
    mapping = sources.table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_suppkey").cast("long").alias("l_suppkey"))
    out = panel.either_code(codes, mapping, "code", "l_partkey", "l_suppkey")
    return out.select("code", F.array_join(F.transform("candidates", lambda x: x.cast("string")), " ").alias("candidates"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority LIKE '1%' AS done FROM orders)
SELECT o_custkey, o_orderkey, done FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY done DESC, CASE WHEN done THEN o_orderkey ELSE -o_orderkey END) = 1""")
def first_urgent_order(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").like("1%").alias("done"))
    return panel.first_complete(o, ["o_custkey"], "done", "o_orderkey")


@query(f"""WITH {_PANEL} SELECT o_custkey, year, n_orders, false AS is_boundary FROM cy WHERE year >= 1996 UNION ALL SELECT o_custkey, year, n_orders, true FROM cy WHERE year = 1995""")
def stage_with_boundary(spark: SparkSession, d: str) -> DataFrame:
    y = customer_years(spark, d).select("o_custkey", "year", "n_orders")
    return panel.with_boundary(y.where("year >= 1996"), y.where("year < 1996"), "year")


@query(f"""WITH {_VERSIONS} SELECT 'orders' AS "table", (SELECT count(*) FROM old WHERE o_orderkey % 5 = 0) AS removed, (SELECT count(*) FROM new WHERE o_orderkey % 7 = 0) AS added,
  (SELECT count(*) FROM new WHERE o_orderkey % 7 = 0) + (SELECT count(*) FROM old WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 1) AS unexpected""")
def reconciled_orders(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return panel.reconciled({"orders": (old, new)}, ["o_orderkey"], old.where("o_orderkey % 10 = 0"))


# -- periods and windows ---------------------------------------------------------------------------


@query(f"""WITH {_PANEL}, s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS b, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1)
SELECT o_custkey, CAST(y AS INTEGER) AS year, y < year(b) OR y > year(e) AS illegal, year(b) IN (y, y - 1) OR year(e) IN (y, y - 1) AS boundary,
  CASE WHEN o_custkey % 5 = 0 THEN 'NO_DATE' WHEN o_custkey % 5 = 1 THEN 'YEAR_PRECISION' WHEN o_custkey % 5 = 2 THEN 'UNPARSEABLE' WHEN year(b) < y THEN 'PRE_YEAR' WHEN year(b) > y THEN 'POST_YEAR' ELSE 'IN_YEAR' END AS timing
FROM s, (SELECT unnest(range(1992, 2000)) AS y)""")
def period_checks(spark: SparkSession, d: str) -> DataFrame:
    s = sources.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("b"), F.max("o_orderdate").cast("date").alias("e"))
    p = s.withColumn("year", F.explode(F.array(*[F.lit(y) for y in range(1992, 2000)])))
    k = F.col("o_custkey") % 5
    date = F.when(k == 0, F.lit("")).when(k == 1, F.year("b").cast("string")).when(k == 2, F.lit("31/12/1995")).otherwise(F.col("b").cast("string"))
    return p.select("o_custkey", "year", panel.illegal_periods(p, "year", "b", "e").alias("illegal"), panel.boundary_year(F.col("year"), F.col("b"), F.col("e")).alias("boundary"), panel.event_timing(date, F.lit("day"), F.col("year")).alias("timing"))


@query(f"""WITH {_PANEL}, w AS (SELECT *, lag(year) OVER v AS py, lead(year) OVER v AS ny, lag(n_orders) OVER v AS po, lead(n_orders) OVER v AS no, lag(spent) OVER v AS ps FROM cy WINDOW v AS (PARTITION BY o_custkey ORDER BY year))
SELECT o_custkey, year, n_orders, round(spent - ps, 2) AS spent_diff, coalesce(year = py + 1 AND n_orders <> po, false) AS changed_from_previous,
  coalesce(year = py + 1 AND n_orders <> po, false) OR coalesce(year + 1 = ny AND n_orders <> no, false) AS changed_at_all, CASE WHEN py = year - 1 THEN po END AS n_orders_previous FROM w""")
def year_on_year(spark: SparkSession, d: str) -> DataFrame:
    y = panel.differenced(customer_years(spark, d), "o_custkey", "year", ["spent"])
    y = panel.previous(panel.discontinuities(y, "o_custkey", "year", F.col("n_orders")), "o_custkey", "year", ["n_orders"])
    return y.select("o_custkey", "year", "n_orders", r("spent_diff", 2).alias("spent_diff"), "changed_from_previous", "changed_at_all", "n_orders_previous")


@query(f"""WITH {_PANEL}, m AS (SELECT o_custkey, arg_max(n_orders, year) AS n_orders, min(year) AS first_period, max(year) AS last_period, count(DISTINCT year) AS n_periods FROM cy GROUP BY 1)
SELECT *, CAST((row_number() OVER (ORDER BY o_custkey) - 1) // 50 + 1 AS BIGINT) AS chunk_id, CAST((row_number() OVER (ORDER BY o_custkey) - 1) % 50 + 1 AS BIGINT) AS chunk_position FROM m""")
def customer_manifest(spark: SparkSession, d: str) -> DataFrame:
    return panel.target_manifest(customer_years(spark, d), "o_custkey", "year", ["n_orders"], 50)


# -- audits ----------------------------------------------------------------------------------------


@query(f"""WITH {_PANEL} SELECT 1 AS step, 'years' AS stage, count(*) AS n FROM panel UNION ALL SELECT 2, 'returned', count(returned) FROM panel UNION ALL SELECT 3, 'many', count(CASE WHEN n_orders > 2 THEN returned END) FROM panel""")
def panel_flow(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d)
    has = p.where("returned is not null")
    return audits.sample_flow({"years": p, "returned": has, "many": has.where("n_orders > 2")})


@query(f"""WITH {_PANEL}, l AS (SELECT n_name, count(*) AS n, count(CASE WHEN returned IS NOT NULL AND spent > 0 THEN 1 END) AS n_complete FROM panel GROUP BY 1)
SELECT n_name, n, n_complete, round(n_complete / n, 6) AS rate, y.ok AS in_reference FROM l JOIN (SELECT n_name, count(DISTINCT year) FILTER (WHERE year IN (1993, 1994, 1995)) = 3 AS ok FROM panel GROUP BY 1) y USING (n_name)""")
def nation_availability(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d)
    rates = audits.complete_coverage(p, ["n_name"], ["returned", "spent"])
    return rates.join(audits.available_in_all(p, "n_name", "year", [1993, 1994, 1995], p).select("n_name", "in_reference"), "n_name").withColumn("rate", r("rate"))


@query(f"""WITH {_PANEL}, m AS (SELECT count(*) AS n, round(avg(record_present), 6) AS present, count(DISTINCT n_name) AS nations FROM panel)
SELECT *, CASE WHEN present >= 0.999999 THEN '' ELSE 'all_present' END || CASE WHEN nations >= 20 THEN '' ELSE 'nations' END AS failed, CASE WHEN present >= 0.999999 AND nations >= 20 THEN 'PASS' ELSE 'FAIL' END AS status FROM m""")
def panel_verdict(spark: SparkSession, d: str) -> DataFrame:
    metrics = {"n": F.count("*"), "present": F.round(F.avg("record_present"), 6), "nations": F.count_distinct("n_name")}
    out = audits.verdict(joined_panel(spark, d), metrics, {"all_present": F.col("present") >= 0.999999, "nations": F.col("nations") >= 20})
    return out.withColumn("failed", F.array_join("failed", ""))


@query(f"""WITH {_PANEL}, m AS (SELECT record_present, count(*) AS n, round(avg(n_orders), 6) AS mean_n_orders, round(avg(spent), 2) AS mean_spent FROM panel GROUP BY 1) SELECT * FROM m""")
def means_by_record(spark: SparkSession, d: str) -> DataFrame:
    out = audits.means_by_presence(joined_panel(spark, d), "record_present", ["n_orders", "spent"])
    return out.select("record_present", "n", r("mean_n_orders").alias("mean_n_orders"), r("mean_spent", 2).alias("mean_spent"))


@query("""WITH s AS (SELECT o_custkey, bool_and(o_orderpriority < '5') AS a, bool_and(o_orderpriority >= '5') AS f, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS reasons FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a THEN 'COMPLETE' WHEN f THEN 'QUERY_FAILED' ELSE 'PARTIAL' END AS status, reasons FROM s""")
def customer_status(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_custkey", (F.col("o_orderpriority") < "5").alias("done"), (F.col("o_orderpriority") >= "5").alias("failed"), "o_orderpriority")
    return audits.entity_status(o, "o_custkey", "done", "failed", "o_orderpriority")


@query(f"""WITH {_PANEL}, m AS (SELECT year, 'spent' AS metric, spent AS x FROM panel UNION ALL SELECT year, 'returned', returned FROM panel)
SELECT year, metric, count(x) AS n, round(avg(x), 2) AS mean, round(median(x), 2) AS median, round(stddev_samp(x), 2) AS sd FROM m GROUP BY 1, 2""")
def yearly_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = audits.by_period(joined_panel(spark, d), "year", ["spent", "returned"])
    return out.select("year", "metric", "n", *[r(c, 2).alias(c) for c in ("mean", "median", "sd")])


@query(f"""WITH {_PANEL} SELECT o_custkey, any_value(n_orders) FILTER (WHERE year = 1994) AS "1994", any_value(n_orders) FILTER (WHERE year = 1995) AS "1995", any_value(n_orders) FILTER (WHERE year = 1996) AS "1996" FROM cy GROUP BY 1""")
def order_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return audits.trajectory(customer_years(spark, d), "o_custkey", "year", "n_orders", [1994, 1995, 1996])


@query(f"""WITH {_PANEL}, f AS (SELECT n_orders > 1 AS many, coalesce(returned > 100000, false) AS high, spent < 0 AS never FROM panel), c AS (SELECT a.x AS many, b.x AS high, e.x AS never FROM (VALUES (true), (false)) a(x), (VALUES (true), (false)) b(x), (VALUES (true), (false)) e(x))
SELECT c.many, c.high, c.never, count(f.many) AS n FROM c LEFT JOIN f ON c.many = f.many AND c.high = f.high AND c.never = f.never GROUP BY 1, 2, 3""")
def flag_combinations(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d).select((F.col("n_orders") > 1).alias("many"), (F.col("returned") > 100000).alias("high"), (F.col("spent") < 0).alias("never"))
    return audits.flag_overlap(p, ["many", "high", "never"])


@query("""SELECT l.quality, l.toxic, d.lang, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return audits.confusion(sources.table(spark, d, "labels").join(sources.table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "quality", "toxic", ["lang"])


@query("""WITH k AS (SELECT doc_id, quality = 1 AS o, toxic = 0 AS w FROM labels) SELECT count(CASE WHEN o AND w THEN 1 END) AS kept, count(CASE WHEN o AND NOT w THEN 1 END) AS lost, count(CASE WHEN NOT o AND w THEN 1 END) AS gained FROM k""")
def label_regressions(spark: SparkSession, d: str) -> DataFrame:
    labels = sources.table(spark, d, "labels")
    return audits.regressions(labels.select("doc_id", (F.col("quality") == 1).alias("ok")), labels.select("doc_id", (F.col("toxic") == 0).alias("ok")), ["doc_id"], "ok")


@query("""SELECT n_name, string_agg(c_mktsegment || ':' || k, ',' ORDER BY c_mktsegment) AS distribution FROM (SELECT n_name, c_mktsegment, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1""")
def segment_distribution(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer").join(sources.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return audits.distribution_json(c, ["n_name"], "c_mktsegment").withColumn("distribution", F.regexp_replace("distribution", r'[{}"]', ""))


@query("""WITH dup AS (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0), k AS (SELECT o_custkey, count(*) AS n FROM dup GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS member_rows, count(*) FILTER (WHERE n > 1) AS groups, count(*) AS keys, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS exact_duplicates,
  (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM k)) AS observed, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM k)) AS unobserved FROM k""")
def order_duplicates(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return audits.duplicate_audit(o.union(o.where("o_orderkey % 5 = 0")), ["o_custkey"], sources.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")))


# -- evidence --------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT o_custkey, CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END AS t, o_orderpriority AS v FROM orders), e AS (SELECT o_custkey, t, min(v) AS lo, max(v) AS hi FROM t GROUP BY 1, 2),
b AS (SELECT o_custkey, arg_min(lo, t) AS lo, arg_min(hi, t) AS hi, min(t) AS t, min(lo) AS l, max(hi) AS h FROM e GROUP BY 1)
SELECT o_custkey, CASE WHEN lo = hi THEN lo END AS value, CASE t WHEN 0 THEN 'good' ELSE 'fair' END AS tier, l <> h AS conflict FROM b""")
def preferred_priority(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderpriority") < "3", "good").otherwise("fair").alias("tier"), F.col("o_orderpriority").alias("value"))
    return evidence.preferred(o, ["o_custkey"], "tier", "value", ["good", "fair"])


@query("""WITH e AS (SELECT user_id, ts, event_type FROM events), u AS (SELECT user_id, event_type, max(ts) AS ts FROM e GROUP BY 1, 2) SELECT user_id, event_type, ts FROM u""")
def latest_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = sources.table(spark, d, "events").select("user_id", "event_type", "ts")
    early, late = e.where("pmod(hash(user_id, ts), 2) = 0"), e.where("pmod(hash(user_id, ts), 2) = 1")
    return evidence.upserted(early, late, ["user_id", "event_type"], "ts")


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'fixed' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def fused_segments(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    updates = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "fixed").alias("c_mktsegment"))
    return evidence.fused(c, updates, ["c_custkey"], ["c_mktsegment"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(CAST(toxic AS VARCHAR), 'UNKNOWN') ELSE 'UNKNOWN' END AS state FROM documents LEFT JOIN labels USING (doc_id)""")
def completed_labels(spark: SparkSession, d: str) -> DataFrame:
    known = sources.table(spark, d, "labels").where("doc_id % 3 = 0").select("doc_id", F.col("toxic").cast("string").alias("state"), F.col("quality").alias("review_quality"))
    return evidence.complete_predictions(sources.table(spark, d, "documents"), known, ["doc_id"], "state")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unmapped' WHEN doc_id % 7 = 0 THEN 'content_missing' WHEN doc_id % 11 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS status FROM documents""")
def text_provenance(spark: SparkSession, d: str) -> DataFrame:
    docs = sources.table(spark, d, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    manifest = docs.where("doc_id % 5 <> 0").withColumn("sha", F.when(F.col("doc_id") % 11 == 0, F.lit("other")).otherwise(F.col("sha")))
    return evidence.provenance(docs, manifest, docs.where("doc_id % 7 <> 0").select("url", "sha"), ["doc_id"], "url", "sha").select("doc_id", "status")


# -- text ------------------------------------------------------------------------------------------

_PERIOD = "CASE WHEN turn >= 3 THEN turn - 1 ELSE turn END"
_MERGED = f"(SELECT conv_id, {_PERIOD} AS turn, text FROM conversations)"
_THEMES = {"a": ["the", "and"], "b": ["to"]}


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Turns as documents of periods, where the second has two of them."""
    key = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("s")).alias("key")
    return sources.table(spark, d, "conversations").select("conv_id", F.expr(_PERIOD).alias("turn"), "text", key)


# Written from the rule: a row is a document; it has a value if the entity has exactly one row in the period before, the
# cosine of the two rows' vectors over all rows' terms, or over the rows up to its own period.
_DOCS = f"""t AS (SELECT conv_id, said, turn, regexp_replace(lower(coalesce(text, '')), '[^一-鿿a-z0-9]', '', 'g') AS x, text FROM (SELECT conv_id, turn AS said, {_PERIOD} AS turn, text FROM conversations)),
g AS (SELECT conv_id, said, turn, substr(x, i, k) AS term FROM (SELECT conv_id, said, turn, x, k, unnest(range(1, length(x) - k + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS k FROM t) WHERE length(x) >= k)),
c AS (SELECT conv_id, said, turn, term, count(*) AS c FROM g GROUP BY ALL),
pairs AS (SELECT a.conv_id, a.said, a.turn, (SELECT min(b.said) FROM t b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1 HAVING count(*) = 1) AS before FROM t a)"""


@query(f"""WITH {_DOCS}, f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
v AS (SELECT conv_id, said, term, (1 + ln(c)) * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term) WHERE df >= 2),
l AS (SELECT conv_id, said, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1, 2),
s AS (SELECT p.conv_id, p.said, sum(a.w * b.w) AS dot FROM pairs p JOIN v a ON a.conv_id = p.conv_id AND a.said = p.said JOIN v b ON b.conv_id = p.conv_id AND b.said = p.before AND b.term = a.term GROUP BY 1, 2)
SELECT p.conv_id, p.said, p.turn, round(CASE WHEN a.norm IS NOT NULL AND b.norm IS NOT NULL THEN least(greatest(coalesce(dot, 0) / a.norm / b.norm, 0), 1) END, 6) AS continuity
FROM pairs p LEFT JOIN l a ON a.conv_id = p.conv_id AND a.said = p.said LEFT JOIN l b ON b.conv_id = p.conv_id AND b.said = p.before LEFT JOIN s ON s.conv_id = p.conv_id AND s.said = p.said""")
def repeated_turn_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Each document has its own value where the period before has exactly one, also where its own period has two."""
    return text.continuity(_merged(spark, d), "conv_id", "turn", "text", ident="key").select(F.col("key.c").alias("conv_id"), F.col("key.s").alias("said"), "turn", r("continuity").alias("continuity"))


@query(f"""WITH {_DOCS}, y AS (SELECT DISTINCT turn AS as_of FROM t), n AS (SELECT as_of, count(*) AS n FROM y JOIN t ON t.turn <= as_of GROUP BY 1),
f AS (SELECT as_of, term, count(*) AS df FROM y JOIN c ON c.turn <= as_of GROUP BY 1, 2),
v AS (SELECT conv_id, said, as_of, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f USING (term) JOIN n USING (as_of) WHERE df >= 2 AND as_of BETWEEN c.turn AND c.turn + 1),
l AS (SELECT conv_id, said, as_of, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
s AS (SELECT p.conv_id, p.said, sum(a.w * b.w) AS dot FROM pairs p JOIN v a ON a.conv_id = p.conv_id AND a.said = p.said AND a.as_of = p.turn JOIN v b ON b.conv_id = p.conv_id AND b.said = p.before AND b.as_of = p.turn AND b.term = a.term GROUP BY 1, 2)
SELECT p.conv_id, p.said, p.turn, round(CASE WHEN a.norm IS NOT NULL AND b.norm IS NOT NULL THEN least(greatest(coalesce(dot, 0) / a.norm / b.norm, 0), 1) END, 6) AS continuity_expanding
FROM pairs p LEFT JOIN l a ON a.conv_id = p.conv_id AND a.said = p.said AND a.as_of = p.turn LEFT JOIN l b ON b.conv_id = p.conv_id AND b.said = p.before AND b.as_of = p.turn LEFT JOIN s ON s.conv_id = p.conv_id AND s.said = p.said""")
def repeated_turn_continuity_expanding(spark: SparkSession, d: str) -> DataFrame:
    out = text.expanding_continuity(_merged(spark, d), "conv_id", "turn", "text", ident="key")
    return out.select(F.col("key.c").alias("conv_id"), F.col("key.s").alias("said"), "turn", r("continuity_expanding").alias("continuity_expanding"))


def _count(term: str) -> str:
    return f"(length(text) - length(replace(text, '{term}', ''))) / {len(term)}"


@query(f"""WITH t AS (SELECT conv_id, turn AS said, {_PERIOD} AS turn, text FROM conversations), v AS (SELECT conv_id, said, turn, {_count("the")} + {_count("and")} AS a, {_count("to")} AS b FROM t),
b AS (SELECT conv_id, turn, min(a) AS a, min(b) AS b FROM v GROUP BY 1, 2 HAVING count(*) = 1)
SELECT v.conv_id, v.said, v.turn, round(CASE WHEN v.a + v.b > 0 AND b.a + b.b > 0 THEN least(greatest((v.a * b.a + v.b * b.b) / sqrt(v.a * v.a + v.b * v.b) / sqrt(b.a * b.a + b.b * b.b), 0), 1) END, 6) AS continuity_theme
FROM v LEFT JOIN b ON v.conv_id = b.conv_id AND v.turn = b.turn + 1""")
def repeated_theme_turns(spark: SparkSession, d: str) -> DataFrame:
    out = text.theme_continuity(_merged(spark, d), "conv_id", "turn", "text", _THEMES, ident="key")
    return out.select(F.col("key.c").alias("conv_id"), F.col("key.s").alias("said"), "turn", r("continuity_theme").alias("continuity_theme"))


@query(f"""WITH v AS (SELECT conv_id, turn, {_count("the")} + {_count("and")} AS a, {_count("to")} AS b FROM conversations)
SELECT v.conv_id, v.turn, round(CASE WHEN v.a + v.b > 0 AND p.a + p.b > 0 THEN least(greatest((v.a * p.a + v.b * p.b) / sqrt(v.a * v.a + v.b * v.b) / sqrt(p.a * p.a + p.b * p.b), 0), 1) END, 6) AS continuity_theme
FROM v LEFT JOIN v p ON v.conv_id = p.conv_id AND v.turn = p.turn + 1""")
def theme_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = sources.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return text.theme_continuity(turns, "conv_id", "turn", "text", _THEMES).withColumn("continuity_theme", r("continuity_theme"))


@query("""WITH v AS (SELECT conv_id, turn, length(text) AS n, CAST(1 + length(text) % 3 AS INTEGER) AS t FROM conversations)
SELECT v.conv_id, v.turn, round((ln(1 + v.n) + ln(1 + p.n)) / 2, 6) AS mean_log_length, round(abs(ln(1 + v.n) - ln(1 + p.n)), 6) AS diff_log_length, v.t AS tier, p.t AS tier_previous,
  CASE WHEN p.t IS NOT NULL THEN greatest(v.t, p.t) END AS tier_max, v.t <> p.t AS tier_changed, CASE WHEN p.t IS NOT NULL THEN v.t <= 2 AND p.t <= 2 END AS both_good
FROM v LEFT JOIN v p ON v.conv_id = p.conv_id AND v.turn = p.turn + 1""")
def turn_controls(spark: SparkSession, d: str) -> DataFrame:
    turns = sources.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (1 + F.length("text") % 3).alias("t"))
    out = text.pair_controls(turns, "conv_id", "turn", "n", "t")
    return out.withColumns({"mean_log_length": r("mean_log_length"), "diff_log_length": r("diff_log_length")})


@query(f"""WITH t AS {_MERGED}, f AS (SELECT conv_id, min(turn) AS f FROM t GROUP BY 1), n AS (SELECT conv_id, turn + 1 AS turn, count(*) AS n FROM t GROUP BY 1, 2)
SELECT t.conv_id, t.turn, CASE WHEN t.turn = f THEN 'first_period' WHEN coalesce(n <> 1, true) THEN 'missing_previous' WHEN length(text) % 4 = 0 THEN 'empty_vector' ELSE 'ok' END AS metric_flag
FROM t JOIN f USING (conv_id) LEFT JOIN n ON t.conv_id = n.conv_id AND t.turn = n.turn""")
def turn_flags(spark: SparkSession, d: str) -> DataFrame:
    turns = _merged(spark, d).withColumn("m", F.when(F.length("text") % 4 != 0, F.lit(1.0)))
    return text.metric_flag(turns, "conv_id", "turn", "m").select("conv_id", "turn", "metric_flag")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^一-鿿a-z0-9]', '', 'g') AS x FROM conversations),
c AS (SELECT conv_id, turn, term, count(*) AS c FROM (SELECT conv_id, turn, substr(x, i, 3) AS term FROM (SELECT *, unnest(range(1, length(x) - 1)) AS i FROM t WHERE length(x) >= 3)) GROUP BY ALL),
m AS (SELECT a.conv_id, a.turn, a.term, least(a.c, b.c) AS m FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.term = b.term),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY m DESC, term) AS r FROM m)
SELECT conv_id, turn, string_agg(term, ' ' ORDER BY r) AS terms FROM k WHERE r <= 5 GROUP BY 1, 2""")
def shared_turn_terms(spark: SparkSession, d: str) -> DataFrame:
    turns = sources.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return text.shared_terms(turns, "conv_id", "turn", "text", 5, 3, 3)


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) < 600 THEN 'too_short' WHEN NOT contains(text, 'the') THEN 'phrase_absent' WHEN NOT contains(text, CAST(doc_id % 10 AS VARCHAR)) THEN 'year_absent' WHEN NOT contains(text, lang) THEN 'place_absent' ELSE 'ok' END AS review FROM documents""")
def document_reviews(spark: SparkSession, d: str) -> DataFrame:
    docs = sources.table(spark, d, "documents").select("doc_id", "text", "lang")
    review = text.document_review(F.col("text"), F.lit("title"), F.col("doc_id") % 10, F.col("lang"), "the", least=600)
    return docs.select("doc_id", review.alias("review"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AS secure FROM pages""")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    pages = sources.table(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", fn.host(F.col("url")).alias("host"), (F.try_parse_url("url", F.lit("PROTOCOL")) == "https").alias("secure"))


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN 'N' || c_nationkey END AS code, c_nationkey AS name FROM customer)
SELECT c_custkey, 'N' || name AS code FROM k""")
def recovered_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    c = sources.table(spark, d, "customer").select("c_custkey", code.alias("code"), F.col("c_nationkey").alias("name"))
    return cleaning.recovered_keys(c, "code", "name").select("c_custkey", "code")
