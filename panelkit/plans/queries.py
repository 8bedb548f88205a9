"""Queries that apply the operators to whole tables, and their DuckDB SQL.

Customers' yearly orders are the entity-period panel, returned line items the second fact table with gaps, and
turns of conversations the corpus of adjacent documents. Doubles are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import contracts, sources
from panelkit import functions as fn
from panelkit.operators import audits, cleaning, evidence, panel, sampling, stats, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """A double rounded as the SQL rounds it: times a power of ten, to the nearest integer, divided again; 641 / 640 is 1.001562, not 1.001563."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


# -- the panel -------------------------------------------------------------------------------------


def customer_years(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, year, n_orders, spent)."""
    orders = sources.table(spark, d, "orders")
    return orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").cast("double").alias("spent"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, year, n_returned, returned) of returned line items: some customer-years have none."""
    lines = sources.table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice")
    orders = sources.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "year").agg(F.count("*").alias("n_returned"), F.sum("l_extendedprice").cast("double").alias("returned"))


_PANEL = """
cy AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders, CAST(sum(o_totalprice) AS DOUBLE) AS spent FROM orders GROUP BY 1, 2),
ret AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_returned, CAST(sum(l_extendedprice) AS DOUBLE) AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
panel AS (SELECT cy.*, n_returned, returned, CASE WHEN ret.o_custkey IS NULL THEN 0 ELSE 1 END AS record_present, c_name, n_name, n_regionkey
  FROM cy LEFT JOIN ret ON cy.o_custkey = ret.o_custkey AND cy.year = ret.year
  JOIN customer ON cy.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def joined_panel(spark: SparkSession, d: str, checked: bool = False) -> DataFrame:
    nation = sources.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = sources.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    profile = customer.join(nation, "n_nationkey").drop("n_nationkey")
    out = panel.with_record(customer_years(spark, d), returns(spark, d), ["o_custkey", "year"], checked=checked)
    return panel.lookup(out, profile, ["o_custkey"]) if checked else out.join(profile, "o_custkey")


@query(f"""WITH {_PANEL}
SELECT o_custkey, year, n_orders, round(spent, 2) AS spent, n_returned, round(returned, 2) AS returned, record_present, c_name, n_name,
  round(CASE WHEN spent > 0 THEN returned / spent END, 6) AS return_share, round(CASE WHEN spent > 0 THEN ln(spent) END, 6) AS spent_ln
FROM panel""")
def customer_year_panel(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d, checked=True)
    p = cleaning.derived(p, {"return_share": ("returned", "spent")}, {"spent_ln": "spent"})
    p = cleaning.assert_finite(p, ["return_share", "spent_ln"])
    return p.select("o_custkey", "year", "n_orders", r("spent", 2).alias("spent"), "n_returned", r("returned", 2).alias("returned"), "record_present", "c_name", "n_name", r("return_share").alias("return_share"), r("spent_ln").alias("spent_ln"))


@query(f"""WITH {_PANEL}
SELECT n_name, year, 'returned' AS field, count(returned) AS n, count(*) AS denominator, round(count(returned) / count(*), 6) AS rate FROM panel GROUP BY 1, 2
UNION ALL SELECT n_name, year, 'spent', count(spent), count(*), round(count(spent) / count(*), 6) FROM panel GROUP BY 1, 2""")
def coverage_by_nation_year(spark: SparkSession, d: str) -> DataFrame:
    return audits.coverage(joined_panel(spark, d), ["n_name", "year"], ["returned", "spent"]).withColumn("rate", r("rate"))


@query(f"""WITH {_PANEL}
SELECT CASE WHEN grouping(n_regionkey) = 1 THEN 'ALL' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey, CASE WHEN grouping(n_name) = 1 THEN 'ALL' ELSE n_name END AS n_name,
  count(*) AS n, CAST(sum(record_present) AS BIGINT) AS n_ok, round(avg(record_present), 6) AS rate, avg(record_present) >= 0.5 AS passed
FROM panel GROUP BY ROLLUP (n_regionkey, n_name)""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d).withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    return audits.gate(p, ["n_regionkey", "n_name"], F.col("record_present") == 1, 0.5).withColumn("rate", r("rate"))


@query(f"""WITH {_PANEL}, t AS (SELECT n_name, count(*) AS t FROM panel GROUP BY 1), c AS (
  SELECT n_name, 'FIELD_MISSING:returned' AS cause FROM panel WHERE returned IS NULL
  UNION ALL SELECT n_name, 'few_orders' FROM panel WHERE n_orders < 2 UNION ALL SELECT n_name, 'low_spend' FROM panel WHERE spent < 100000)
SELECT n_name, cause, count(*) AS n, round(count(*) / any_value(t), 6) AS share FROM c JOIN t USING (n_name) GROUP BY 1, 2""")
def failure_causes(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d).withColumn("reason", fn.flag_list({"few_orders": F.col("n_orders") < 2, "low_spend": F.col("spent") < 100000}, none=""))
    return audits.failures(p, ["n_name"], ["returned"], "reason").withColumn("share", r("share"))


@query(f"""WITH {_PANEL}, s AS (SELECT 'all' AS stratum, record_present FROM panel
  UNION ALL SELECT 'many_orders', record_present FROM panel WHERE n_orders >= 3 UNION ALL SELECT 'big_spender', record_present FROM panel WHERE spent >= 300000)
SELECT stratum, count(*) AS n, CAST(sum(record_present) AS BIGINT) AS n_covered, round(avg(record_present), 6) AS rate FROM s GROUP BY 1""")
def overlapping_strata(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d)
    return audits.strata_coverage(p, {"many_orders": F.col("n_orders") >= 3, "big_spender": F.col("spent") >= 300000}, F.col("record_present") == 1).withColumn("rate", r("rate"))


_STATS = "round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS sd, round(min({0}), 4) AS min, round(quantile_cont({0}, 0.25), 4) AS p25, round(median({0}), 4) AS p50, round(quantile_cont({0}, 0.75), 4) AS p75, round(max({0}), 4) AS max, round(avg(CASE WHEN {0} = 1 THEN 1.0 WHEN {0} IS NOT NULL THEN 0.0 END), 6) AS share_one"


@query(f"WITH {_PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, " + _STATS.format(f"CAST({c} AS DOUBLE)") + " FROM panel" for c in ("n_orders", "spent", "returned")))
def variable_summary(spark: SparkSession, d: str) -> DataFrame:
    out = audits.describe(joined_panel(spark, d), ["n_orders", "spent", "returned"])
    return out.select("variable", "n", "missing", *[r(c, 4).alias(c) for c in ("mean", "sd", "min", "p25", "p50", "p75", "max")], r("share_one").alias("share_one"))


@query(f"WITH {_PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM panel" for a, b in (("n_orders", "spent"), ("n_orders", "returned"), ("spent", "returned"))))
def pairwise_correlations(spark: SparkSession, d: str) -> DataFrame:
    return audits.correlations(joined_panel(spark, d), ["n_orders", "spent", "returned"]).withColumn("r", r("r"))


@query(f"""WITH {_PANEL}, b AS (SELECT spent, returned FROM panel WHERE spent IS NOT NULL AND returned IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY spent) + (count(*) OVER (PARTITION BY spent) - 1) / 2 AS x, rank() OVER (ORDER BY returned) + (count(*) OVER (PARTITION BY returned) - 1) / 2 AS y FROM b)
SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM k""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return audits.spearman(joined_panel(spark, d), "spent", "returned").withColumn("rho", r("rho"))


# -- cleaning and duplicates -----------------------------------------------------------------------


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_acctbal * 1.0 AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS cleaned,
  CAST(1990 + c_nationkey AS INTEGER) AS year, DATE '1899-12-30' + CAST(40000 + c_nationkey AS INTEGER) AS day, c_nationkey / 100 AS share FROM customer""")
def dirty_values(spark: SparkSession, d: str) -> DataFrame:
    """Values made dirty in the query and cleaned again."""
    c = sources.table(spark, d, "customer")
    raw = c.select(
        "c_custkey",
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 ")).alias("code"),
        F.format_number(F.col("c_acctbal").cast("decimal(15,2)"), 2).alias("balance"),
        F.when(F.col("c_custkey") % 7 == 0, F.element_at(F.array(F.lit("-"), F.lit("NA")), (F.col("c_custkey") % 2 + 1).cast("int"))).otherwise(F.col("c_nationkey").cast("string")).alias("cleaned"),
        F.concat((F.col("c_nationkey") + 1990).cast("string"), F.lit("年")).alias("year"),
        (F.col("c_nationkey") + 40000).cast("string").alias("day"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("share"),
    )
    return raw.select("c_custkey", fn.code(F.col("code")).alias("code"), fn.number(F.col("balance")).alias("balance"), fn.number(F.col("cleaned")).alias("cleaned"), fn.year(F.col("year"), 1990, 2030).alias("year"), fn.date(F.col("day")).alias("day"), fn.percent(F.col("share")).alias("share"))


_DUP = "dup AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 11 = 0)"


def _duplicated(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    again = o.where("o_orderkey % 5 = 0")
    empty = o.where("o_orderkey % 11 = 0").withColumn("o_totalprice", F.lit(None).cast(o.schema["o_totalprice"].dataType))
    return o.union(again).union(empty)


@query(f"""WITH {_DUP} SELECT o_orderkey, count(*) AS n_rows, CASE WHEN count(DISTINCT coalesce(CAST(o_totalprice AS VARCHAR), '') || '|' || o_custkey) = 1 THEN 'exact' ELSE 'conflict' END AS kind
FROM dup GROUP BY 1 HAVING count(*) > 1""")
def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.duplicate_classes(_duplicated(spark, d), ["o_orderkey"])


@query(f"WITH {_DUP} SELECT o_orderkey, any_value(o_custkey) AS o_custkey, CAST(max(o_totalprice) AS DOUBLE) AS o_totalprice FROM dup GROUP BY 1")
def fullest_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = cleaning.keep_fullest(_duplicated(spark, d).withColumn("pos", F.lit(0)), ["o_orderkey"], "pos")
    return kept.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("""WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), m AS (SELECT count(v) AS n, median(v) AS m, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x),
a AS (SELECT median(abs(v - m)) AS mad FROM x, m) SELECT round(CASE WHEN n >= 3 THEN CASE WHEN mad > 0 THEN m + 10 * mad WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) END END, 4) AS bound FROM m, a""")
def outlier_bound(spark: SparkSession, d: str) -> DataFrame:
    x = sources.table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"))
    return cleaning.upper_bound(x, "v").select(r("bound", 4).alias("bound"))


@query("SELECT user_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    e = sources.table(spark, d, "events")
    last = cleaning.keep_last(e.select("user_id", "ts", "event_type"), ["user_id"], "ts").select("user_id", "ts")
    return last.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


# -- time ------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate) AS b, max(o_orderdate) AS e FROM orders GROUP BY 1), y AS (
  SELECT o_custkey, unnest(range(greatest(1993, year(b)), least(1997, year(CAST(e AS DATE) - 1)) + 1)) AS year FROM s)
SELECT o_custkey, CAST(year AS INTEGER) AS year FROM y""")
def active_years(spark: SparkSession, d: str) -> DataFrame:
    spans = sources.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("b"), F.max("o_orderdate").alias("e"))
    return panel.expand_years(spans, "b", "e", 1993, 1997).select("o_custkey", "year")


@query("""WITH e AS (SELECT o_custkey, o_orderdate AS d, o_orderpriority AS new, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders),
c AS (SELECT o_custkey, d, max(new) AS new, min(old) AS old FROM e WHERE old IS NOT NULL GROUP BY 1, 2), p AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders)
SELECT p.o_custkey, CAST(p.year AS INTEGER) AS year, coalesce(arg_max(c.new, c.d) FILTER (WHERE year(c.d) <= p.year), CASE WHEN count(c.d) FILTER (WHERE year(c.d) <= p.year) = 0 THEN arg_min(c.old, c.d) END) AS priority
FROM p LEFT JOIN c ON p.o_custkey = c.o_custkey GROUP BY 1, 2""")
def priority_as_of(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = sources.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = o.select("o_custkey", F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("new"), F.lag("o_orderpriority").over(w).alias("old")).where("old is not null")
    e = e.groupBy("o_custkey", "date").agg(F.max("new").alias("new"), F.min("old").alias("old"))
    periods = o.select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    return panel.as_of(periods, e, "o_custkey", "year", "date", "old", "new", "priority")


@query("""WITH s AS (SELECT c_nationkey, c_custkey, min(o_orderdate) AS b, max(o_orderdate) AS e FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.c_nationkey, bool_or(EXISTS (SELECT 1 FROM s x WHERE x.c_nationkey = a.c_nationkey AND x.c_custkey <> a.c_custkey AND x.b <= a.e AND a.b <= x.e)) AS has_overlap FROM s a GROUP BY 1""")
def overlapping_customers(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").join(sources.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spans = o.groupBy("c_nationkey", "c_custkey").agg(F.min("o_orderdate").alias("b"), F.max("o_orderdate").alias("e"))
    return panel.overlapping(spans, ["c_nationkey"], "c_custkey", "b", "e")


@query(f"""WITH {_PANEL}, g AS (SELECT n_name, year, sum(n_orders) AS v FROM panel GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY n_name ORDER BY year) AS lagged FROM g)
SELECT o_custkey, p.year, CAST(lagged AS BIGINT) AS lagged FROM panel p JOIN l ON p.n_name = l.n_name AND p.year = l.year""")
def lagged_nation_orders(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d)
    g = p.groupBy("n_name", "year").agg(F.sum("n_orders").alias("v"))
    return panel.group_lag(p.join(g, ["n_name", "year"]), "n_name", "year", "v", "lagged").select("o_custkey", "year", "lagged")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name, c_custkey) - 1) // 100 + 1 AS BIGINT) AS chunk_id, CAST((row_number() OVER (ORDER BY c_name, c_custkey) - 1) % 100 + 1 AS BIGINT) AS chunk_position FROM customer")
def customer_chunks(spark: SparkSession, d: str) -> DataFrame:
    return panel.chunks(sources.table(spark, d, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"], 100).select("c_custkey", "chunk_id", "chunk_position")


# -- sets, samples, fingerprints -------------------------------------------------------------------


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_a, (SELECT count(*) FROM customer) AS n_b, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS n_both,
  (SELECT count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)) AS n_union, false AS disjoint, true AS a_within_b, (SELECT count(DISTINCT o_custkey) FROM orders) = (SELECT count(*) FROM customer) AS equal""")
def customer_sets(spark: SparkSession, d: str) -> DataFrame:
    a = sources.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return panel.set_relations(a, sources.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("""SELECT c_custkey, c_mktsegment, CAST(rn AS INTEGER) AS rank_in_stratum FROM (SELECT c_custkey, c_mktsegment,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_mktsegment || '|' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 5 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    c = sources.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sampling.stratified(c, "c_custkey", "c_mktsegment", dict.fromkeys(("BUILDING", "MACHINERY", "AUTOMOBILE"), 5), 7)


@query("SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS sha256 FROM (SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS x FROM nation)")
def nation_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return contracts.exact_fingerprint(sources.table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def _fold_sql(names: str) -> str:
    """Names of each group g in order, one after the other: a batch takes a name if it has under 12 and comes to 240 characters at most."""
    return f"""WITH RECURSIVE s AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS n FROM ({names})),
f AS (SELECT g, n, v, 1 AS batch, 1 AS items, length(v) AS chars FROM s WHERE n = 1 UNION ALL
  SELECT s.g, s.n, s.v, CASE WHEN items = 12 OR chars + 4 + length(s.v) > 240 THEN batch + 1 ELSE batch END, CASE WHEN items = 12 OR chars + 4 + length(s.v) > 240 THEN 1 ELSE items + 1 END,
    CASE WHEN items = 12 OR chars + 4 + length(s.v) > 240 THEN length(s.v) ELSE chars + 4 + length(s.v) END FROM f JOIN s ON s.g = f.g AND s.n = f.n + 1)"""


@query(_fold_sql("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS g, c_name AS v FROM customer") + """
SELECT g AS "group", CAST(batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_items, string_agg(v, ' OR ' ORDER BY v) AS query FROM f GROUP BY 1, 2""")
def query_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(sources.table(spark, d, "customer"), "c_nationkey", "c_name", 12, 240)


@query(_fold_sql("SELECT DISTINCT 'all' AS g, c_name AS v FROM customer") + """
SELECT CAST(batch AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n_items, string_agg(v, ' OR ' ORDER BY v) AS query FROM f GROUP BY 1""")
def name_batches(spark: SparkSession, d: str) -> DataFrame:
    """All customers' names in one order."""
    made, _ = sampling.batch_artifacts(sources.table(spark, d, "customer"), "c_custkey", "c_name", 12, 240)
    return made


@query(_fold_sql("SELECT DISTINCT 'all' AS g, p_name AS v FROM part") + """
SELECT p_partkey, p_name, n_entities, CASE WHEN n_entities > 1 THEN 'collision' ELSE 'unique' END AS attribution, CAST(batch AS INTEGER) AS batch
FROM part JOIN (SELECT p_name, count(DISTINCT p_partkey) AS n_entities FROM part GROUP BY 1) USING (p_name) JOIN f ON v = p_name""")
def name_attributions(spark: SparkSession, d: str) -> DataFrame:
    _, mapped = sampling.batch_artifacts(sources.table(spark, d, "part"), "p_partkey", "p_name", 12, 240)
    return mapped


# -- text ------------------------------------------------------------------------------------------

_GRAMS = """
t AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^一-鿿a-z0-9]', '', 'g') AS x FROM conversations),
g AS (SELECT conv_id, turn, substr(x, i, k) AS term FROM (SELECT conv_id, turn, x, k, unnest(range(1, length(x) - k + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS k FROM t) WHERE length(x) >= k)),
c AS (SELECT conv_id, turn, term, count(*) AS c FROM g GROUP BY ALL)
"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "conversations").select("conv_id", "turn", "text")


@query(f"""WITH {_GRAMS}, n AS (SELECT count(*) AS n FROM t), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT conv_id, turn, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN f USING (term), n),
u AS (SELECT conv_id, turn, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS w FROM w),
h AS (SELECT DISTINCT conv_id, turn FROM u), p AS (SELECT a.conv_id, a.turn, least(greatest(sum(a.w * b.w), 0), 1) AS s FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.term = b.term GROUP BY 1, 2)
SELECT t.conv_id, t.turn, round(CASE WHEN h.turn IS NOT NULL AND k.turn IS NOT NULL THEN coalesce(s, 0) END, 6) AS continuity
FROM t LEFT JOIN h ON t.conv_id = h.conv_id AND t.turn = h.turn LEFT JOIN h k ON t.conv_id = k.conv_id AND t.turn = k.turn + 1 LEFT JOIN p ON t.conv_id = p.conv_id AND t.turn = p.turn""")
def turn_continuity(spark: SparkSession, d: str) -> DataFrame:
    return text.continuity(_turns(spark, d), "conv_id", "turn", "text").withColumn("continuity", r("continuity"))


@query(f"""WITH {_GRAMS}, nn AS (SELECT turn AS as_of, sum(k) OVER (ORDER BY turn) AS n FROM (SELECT turn, count(*) AS k FROM t GROUP BY 1)),
v AS (SELECT c.conv_id, c.turn, a.as_of, c.term, c.c, a.n FROM c JOIN nn a ON a.as_of IN (c.turn, c.turn + 1)),
d AS (SELECT term, turn, sum(k) OVER (PARTITION BY term ORDER BY turn) AS df, lead(turn) OVER (PARTITION BY term ORDER BY turn) AS nxt FROM (SELECT term, turn, count(*) AS k FROM c GROUP BY 1, 2)),
w AS (SELECT v.conv_id, v.turn, v.as_of, v.term, (1 + ln(v.c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM v JOIN d ON v.term = d.term AND d.turn <= v.as_of AND (nxt IS NULL OR nxt > v.as_of) WHERE df >= 2),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn, as_of)) AS x FROM w),
a AS (SELECT * FROM u WHERE as_of = turn), b AS (SELECT * FROM u WHERE as_of = turn + 1),
h AS (SELECT DISTINCT a.conv_id, a.turn FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.as_of),
p AS (SELECT a.conv_id, a.turn, least(greatest(sum(a.x * b.x), 0), 1) AS s FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.as_of AND a.term = b.term GROUP BY 1, 2)
SELECT t.conv_id, t.turn, round(CASE WHEN h.turn IS NOT NULL THEN coalesce(s, 0) END, 6) AS continuity_expanding FROM t LEFT JOIN h USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)""")
def turn_continuity_expanding(spark: SparkSession, d: str) -> DataFrame:
    return text.expanding_continuity(_turns(spark, d), "conv_id", "turn", "text").withColumn("continuity_expanding", r("continuity_expanding"))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS core_hits, CAST((length(text) - length(replace(text, 'and', ''))) / 3 AS BIGINT) AS context_hits FROM documents""")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = sources.table(spark, d, "documents").select("doc_id", "text")
    return text.keyword_paragraphs(docs, "text", ["the"], ["and"]).select("doc_id", "core_hits", "context_hits")


def _page_sql(root: str, after: str) -> str:
    """Texts of pages from their tags: a block lasts to the end tag that closes it or what is around it, counted by depth."""
    return rf"""WITH raw AS (
  SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<(?:script|style|nav|footer)>.*?</(?:script|style|nav|footer)>', '', 'gs') AS h FROM pages
), tokens AS (
  SELECT page_id, x, i, x LIKE '<%' AS tag FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(h, '<[^>]*>|[^<]+') AS l FROM raw))
), placed AS (
  SELECT *, sum(CASE x WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth,
    sum(CASE x WHEN '<article>' THEN 1 WHEN '</article>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS inside FROM tokens
), t AS (
  SELECT page_id, i, trim(replace(replace(replace(x, '&amp;', '&'), '&amp', '&'), '&quot;', '"'), E' \n\t') AS v FROM placed WHERE NOT tag AND ({root}) AND trim(x, E' \n\t') <> ''
), opened AS (
  SELECT a.page_id, a.i, (SELECT min(b.i) FROM placed b WHERE b.page_id = a.page_id AND b.i > a.i
    AND (b.x = '</article>' OR a.x = '<h1>' AND b.x = '</h1>' OR a.x = '<p>' AND b.depth < a.depth)) AS e FROM placed a WHERE a.x IN ('<p>', '<h1>')
), blocks AS (
  SELECT o.page_id, o.i, string_agg(v, ' ' ORDER BY t.i) AS v FROM opened o JOIN t ON t.page_id = o.page_id AND t.i > o.i AND t.i < o.e GROUP BY 1, 2
), lines AS (
  SELECT page_id, 1 AS kind, string_agg(v, chr(10) ORDER BY i) AS v FROM blocks GROUP BY 1 UNION ALL SELECT page_id, 2, string_agg(v, chr(10) ORDER BY i) FROM t GROUP BY 1
), clean AS (
  SELECT page_id, kind, array_to_string([y for y in [trim(regexp_replace(z, '[ \t]+', ' ', 'g')) for z in string_split(v, chr(10))] if y <> ''], chr(10)) AS v FROM lines
), texts AS (
  SELECT page_id, url, CASE WHEN a.v IS NULL OR 2 * length(a.v) < length(b.v) THEN coalesce(b.v, '') ELSE a.v END AS text
  FROM raw LEFT JOIN (SELECT page_id, v FROM clean WHERE kind = 1) a USING (page_id) LEFT JOIN (SELECT page_id, v FROM clean WHERE kind = 2) b USING (page_id)
) {after}"""


@query(_page_sql("true", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, length(text) AS chars, sha256(text) AS sha256 FROM texts"))
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = text.clean_pages(sources.table(spark, d, "pages"), "html")
    return pages.select("page_id", fn.host(F.col("url")).alias("host"), F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


def _hits_sql(x: str, terms: list[str]) -> str:
    return " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in terms)


_CORE, _CONTEXT = ["thing", "ation", "eau"], ["and", "der"]


@query(_page_sql("inside > 0", f"""SELECT page_id, full_chars, kept_chars, round(CASE WHEN full_chars > 0 THEN kept_chars / full_chars ELSE 0 END, 6) AS kept_share, core_hits, context_hits, kept_paragraphs, sha256(kept) AS kept_sha256, 'ok' AS decode_status,
  CASE WHEN flags = '' THEN 'ok' ELSE flags END AS quality_flags FROM (
  SELECT *, concat_ws(';', CASE WHEN full_chars = 0 THEN 'empty_text' WHEN full_chars < 500 THEN 'short_text' END, CASE WHEN kept_chars = 0 THEN 'empty_kept' WHEN kept_chars < 80 THEN 'short_kept' END,
    CASE WHEN full_chars > 0 AND kept_chars / full_chars > 0.95 THEN 'high_share' END) AS flags FROM (
  SELECT page_id, length(text) AS full_chars, length(kept) AS kept_chars, kept, {_hits_sql("text", _CORE)} AS core_hits, {_hits_sql("text", _CONTEXT)} AS context_hits, n AS kept_paragraphs FROM (
  SELECT page_id, text, array_to_string(k, chr(10) || chr(10)) AS kept, CAST(len(k) AS INTEGER) AS n FROM (SELECT page_id, text, [p for p in string_split(text, chr(10)) if {_hits_sql("p", _CORE)} > 0] AS k FROM texts))))"""))
def page_corpus(spark: SparkSession, d: str) -> DataFrame:
    pages = sources.table(spark, d, "pages").select("page_id", F.encode("html", "utf-8").alias("payload"))
    out = text.page_corpus(pages, "payload", _CORE, _CONTEXT, tags=("article",))
    return out.select("page_id", "full_chars", "kept_chars", r("kept_share").alias("kept_share"), "core_hits", "context_hits", "kept_paragraphs", F.sha2("kept_text", 256).alias("kept_sha256"), "decode_status", "quality_flags")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS a FROM pages), k AS (
  SELECT DISTINCT regexp_extract(a, '^[^/?#]+/[^/?#]+', 0) AS prefix, 'section' AS label, 1 AS class FROM p UNION SELECT DISTINCT regexp_extract(a, '^[^/?#]+/', 0), 'site', 2 FROM p UNION SELECT DISTINCT substr(a, 1, 1), substr(a, 1, 1), 3 FROM p),
q AS (SELECT page_id, a AS address FROM p UNION ALL SELECT page_id + 1000000, substr(a, 1, 9) || ' ' || substr(a, 10, 6) FROM p UNION ALL SELECT page_id + 2000000, '-' || a FROM p)
SELECT page_id, address, (SELECT label FROM k WHERE prefix <> '' AND starts_with(replace(address, ' ', ''), prefix) ORDER BY class, length(prefix) DESC, label LIMIT 1) AS label FROM q""")
def address_classes(spark: SparkSession, d: str) -> DataFrame:
    """Sections before sites before first letters, whatever is longer, of whole addresses, cut ones and others."""
    p = sources.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("address"))

    def known(pattern: str, label: Column, rank: int) -> DataFrame:
        return p.select(F.regexp_extract("address", pattern, 0).alias("prefix"), label.alias("label"), F.lit(rank).alias("class")).distinct()

    prefixes = known("^[^/?#]+/[^/?#]+", F.lit("section"), 1).union(known("^[^/?#]+/", F.lit("site"), 2)).union(known("^.", F.substring("address", 1, 1), 3))
    cut = p.select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat(F.substring("address", 1, 9), F.lit(" "), F.substring("address", 10, 6)).alias("address"))
    other = p.select((F.col("page_id") + 2_000_000).alias("page_id"), F.concat(F.lit("-"), "address").alias("address"))
    return evidence.longest_prefix(p.union(cut).union(other), "address", prefixes)


# -- scoring and classes ---------------------------------------------------------------------------


@query("""WITH p AS (SELECT l.doc_id, l.quality, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS predicted, d.lang = 'en' AS valid FROM labels l JOIN documents d USING (doc_id))
SELECT count(*) AS n, count(CASE WHEN valid THEN 1 END) AS n_valid, count(CASE WHEN NOT coalesce(valid, false) THEN 1 END) AS n_excluded, count(CASE WHEN valid AND predicted IS NOT DISTINCT FROM quality THEN 1 END) AS n_correct,
  round(count(CASE WHEN valid AND predicted IS NOT DISTINCT FROM quality THEN 1 END) / count(CASE WHEN valid THEN 1 END), 6) AS accuracy FROM p""")
def rule_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = sources.table(spark, d, "labels").join(sources.table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 500).cast("int"))
    return audits.accuracy(p, "predicted", "quality", F.col("lang") == "en").withColumn("accuracy", r("accuracy"))


@query("""WITH k AS (SELECT regexp_replace(lower(p_name), '[^0-9a-z_]', '', 'g') AS name_key, p_partkey, p_brand, p_type FROM part)
SELECT 'COL-' || substr(sha256(name_key), 1, 16) AS collision_id, name_key, count(DISTINCT p_partkey) AS n_entities, count(DISTINCT p_brand) AS n_orgs, count(DISTINCT p_type) AS n_securities,
  CASE WHEN count(DISTINCT p_brand) = 1 AND count(DISTINCT p_type) > 1 THEN 'shared_entity' ELSE 'unresolved' END AS kind FROM k GROUP BY 2 HAVING count(DISTINCT p_partkey) > 1""")
def name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Whole names that several parts have."""
    c = sources.table(spark, d, "part").select("p_partkey", fn.identity_key(F.col("p_name")).alias("name_key"), "p_brand", "p_type")
    return evidence.collisions(c, "p_partkey", "name_key", "p_brand", "p_type")


def _model_sql(model: str, features: list[str]) -> str:
    """A fixed-effects model from its normal equations: year indicators, all demeaned by entity, solved and inverted by elimination."""
    p = f"(SELECT len(ys) + {len(features)} FROM yrs)"
    return f"""SELECT * FROM (WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS i, o_custkey, n_name, [y, {", ".join(features)}] || [CASE WHEN year = v THEN 1.0 ELSE 0.0 END for v in ys] AS f FROM f, yrs
), long AS (
  SELECT i, o_custkey, n_name, j, f[j + 1] AS v FROM (SELECT *, unnest(range(len(f))) AS j FROM raw)
), dm AS (
  SELECT i, n_name, j, v - avg(v) OVER (PARTITION BY o_custkey, j) AS v FROM long
), g AS (
  SELECT a.j AS j, b.j AS k, sum(a.v * b.v) AS s FROM dm a JOIN dm b USING (i) GROUP BY 1, 2
), m AS (
  SELECT list(l || [CASE WHEN j = k THEN 1.0 ELSE 0.0 END for k in range(1, {p} + 1)] || [y] ORDER BY j) AS m
  FROM (SELECT j, list(s ORDER BY k) FILTER (WHERE k > 0) AS l, max(s) FILTER (WHERE k = 0) AS y FROM g WHERE j > 0 GROUP BY 1)
), e(k, m) AS (
  SELECT 1, m FROM m UNION ALL
  SELECT k + 1, [CASE WHEN i = k THEN [m[k][j] / m[k][k] for j in range(1, len(m[1]) + 1)] ELSE [m[i][j] - m[i][k] / m[k][k] * m[k][j] for j in range(1, len(m[1]) + 1)] END for i in range(1, len(m) + 1)] FROM e WHERE k <= len(m)
), done AS (
  SELECT [r[-1] for r in m] AS b, m[1][len(m) + 1:2 * len(m)] AS inv FROM e ORDER BY k DESC LIMIT 1
), res AS (
  SELECT i, any_value(n_name) AS n_name, sum(CASE WHEN j = 0 THEN v ELSE -b[j] * v END) AS u, sum(CASE WHEN j > 0 THEN inv[j] * v ELSE 0 END) AS w FROM dm, done GROUP BY i
), s AS (
  SELECT n_name, sum(w * u) AS s FROM res GROUP BY 1
), size AS (
  SELECT count(*) AS n, count(DISTINCT o_custkey) AS entities, count(DISTINCT n_name) AS clusters FROM raw
), se AS (
  SELECT b[1] AS beta, sqrt(clusters / (clusters - 1) * (n - 1) / (n - entities - {p}) * (SELECT sum(s * s) FROM s)) AS se, (SELECT sum(u * u) FROM res) AS rss, n, entities, clusters FROM done, size
) SELECT '{model}' AS model, beta, se, rss, n, entities, clusters FROM se)"""


@query(f"""WITH {_PANEL}, f AS (SELECT o_custkey, year, n_name, ln(spent) AS y, CAST(n_orders AS DOUBLE) AS x, CAST(record_present AS DOUBLE) AS z FROM panel WHERE spent > 0),
yrs AS (SELECT list(DISTINCT year ORDER BY year)[2:] AS ys FROM f),
est AS ({_model_sql("base", ["x"])} UNION ALL {_model_sql("controls", ["x", "z"])}), yearly AS ({_model_sql("years", [])}),
-- Student's t with an even number of degrees of freedom is a finite sum; the value that 5 % exceed with 24 of them is a constant.
t AS (SELECT *, beta / se AS t, 24 / (24 + beta * beta / se / se) AS c FROM est)
SELECT t.model, round(t.beta, 6) AS beta, round(t.se, 6) AS se,
  round(1 - abs(t) / sqrt(24 + t * t) * list_sum([list_product([(2 * q - 1) / (2 * q) for q in range(1, o + 1)]) * c ** o for o in range(1, 12)] || [1.0]), 6) AS p,
  round(t.beta - 2.0638985616280205 * t.se, 6) AS low, round(t.beta + 2.0638985616280205 * t.se, 6) AS high, round(1 - t.rss / yearly.rss, 6) AS within_r2, t.n, t.entities, t.clusters FROM t, yearly""")
def spending_model(spark: SparkSession, d: str) -> DataFrame:
    p = joined_panel(spark, d).select("o_custkey", "year", "n_name", F.ln("spent").alias("y"), F.col("n_orders").cast("double").alias("x"), F.col("record_present").cast("double").alias("z"))
    # Both models and their years read the panel: it is joined once.
    out = stats.models(sources.written(p), [{"model": "base", "outcome": "y", "policy": "x"}, {"model": "controls", "outcome": "y", "policy": "x", "controls": ["z"]}], "o_custkey", "year", "n_name")
    return out.select("model", *[r(c).alias(c) for c in ("beta", "se", "p", "low", "high", "within_r2")], "n", "entities", "clusters")


def queries() -> dict[str, Query]:
    from panelkit.plans import evidence_queries, more, samples  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
