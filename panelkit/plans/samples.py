"""Queries over samples, columns, manifests and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit import contracts, sources
from panelkit import functions as fn
from panelkit.operators import audits, cleaning, evidence, panel, sampling, text
from panelkit.plans.queries import _DUP, _duplicated, query, r


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return sources.table(spark, d, "customer")


# -- samples ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_custkey, 'building' AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'rich' FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT c_custkey, 'south' FROM customer WHERE c_nationkey < 3),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sha256('11|' || s || '|' || c_custkey), c_custkey) AS r FROM s)
SELECT c_custkey, string_agg(DISTINCT s, '|' ORDER BY s) AS strata FROM (SELECT c_custkey, s FROM k WHERE r <= 9 UNION ALL SELECT c_custkey, 'forced' FROM customer WHERE c_custkey IN (1, 2, 3)) GROUP BY 1""")
def sample_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping strata: a customer that several of them pick has all their names."""
    strata = {"building": F.col("c_mktsegment") == "BUILDING", "rich": F.col("c_acctbal") > 8000, "south": F.col("c_nationkey") < 3}
    return sampling.memberships(_customers(spark, d), "c_custkey", strata, 9, 11, forced=[1, 2, 3])


@query("""WITH f AS (SELECT c_custkey FROM customer WHERE c_custkey IN (4, 5)),
a AS (SELECT c_custkey FROM customer ANTI JOIN f USING (c_custkey) WHERE c_acctbal > 5000 ORDER BY sha256('5|rich|' || c_custkey), c_custkey LIMIT 12),
b AS (SELECT c_custkey FROM customer ANTI JOIN f USING (c_custkey) ANTI JOIN a USING (c_custkey) WHERE c_mktsegment = 'MACHINERY' ORDER BY sha256('5|machinery|' || c_custkey), c_custkey LIMIT 8),
g AS (SELECT c_custkey FROM customer ANTI JOIN f USING (c_custkey) ANTI JOIN a USING (c_custkey) ANTI JOIN b USING (c_custkey) ORDER BY sha256('5|fill|' || c_custkey), c_custkey LIMIT 18)
SELECT c_custkey, 'forced' AS stratum FROM f UNION ALL SELECT c_custkey, 'rich' FROM a UNION ALL SELECT c_custkey, 'machinery' FROM b UNION ALL SELECT c_custkey, 'fill' FROM g""")
def exclusive_sample(spark: SparkSession, d: str) -> DataFrame:
    """Strata one after the other, each from what is left, filled up to forty."""
    strata = [("rich", F.col("c_acctbal") > 5000, 12), ("machinery", F.col("c_mktsegment") == "MACHINERY", 8)]
    return sampling.exclusive(_customers(spark, d), "c_custkey", strata, 5, least=40, forced=[4, 5])


_LEVEL = """q AS (SELECT c_nationkey, least(count(*), 9) AS q FROM customer GROUP BY 1),
l AS (SELECT max(l) AS l FROM (SELECT l FROM (SELECT unnest(range(1, 10)) AS l), q GROUP BY l HAVING sum(least(q, l)) <= 130)),
o AS (SELECT c_nationkey, q, l, row_number() OVER (PARTITION BY q > l ORDER BY c_nationkey) AS k, (SELECT 130 - sum(least(q, l)) FROM q, l) AS extra FROM q, l),
n AS (SELECT c_nationkey, CASE WHEN q > l AND k <= extra THEN l + 1 ELSE least(q, l) END AS quota FROM o)"""


@query(f"""WITH {_LEVEL}, k AS (SELECT c_custkey, c_nationkey, quota, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('3|' || c_nationkey || '|' || c_custkey), c_custkey) AS rn FROM customer JOIN n USING (c_nationkey))
SELECT c_custkey, c_nationkey, CAST(rn AS INTEGER) AS rank_in_stratum FROM k WHERE rn <= quota""")
def budgeted_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most nine of a nation and 130 in all, the largest nations giving way first."""
    return sampling.budgeted(_customers(spark, d).select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 9, 130, 3)


@query("""WITH h AS (SELECT *, 'high' AS pick FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5), l AS (SELECT *, 'low' AS pick FROM customer ANTI JOIN h USING (c_custkey) ORDER BY c_acctbal, c_custkey LIMIT 5),
m AS (SELECT *, 'middle' AS pick FROM customer ANTI JOIN h USING (c_custkey) ANTI JOIN l USING (c_custkey) ORDER BY sha256('2|middle|' || c_custkey), c_custkey LIMIT 6)
SELECT c_custkey, c_acctbal, pick FROM (SELECT * FROM h UNION ALL SELECT * FROM l UNION ALL SELECT * FROM m)""")
def extreme_customers(spark: SparkSession, d: str) -> DataFrame:
    return sampling.extremes(_customers(spark, d), "c_custkey", "c_acctbal", 5, 6, 2).select("c_custkey", "c_acctbal", "pick")


@query("""WITH t AS (SELECT * FROM (VALUES ('BUILDING', 30), ('MACHINERY', 100000), ('NONE', 4)) v(stratum, target))
SELECT stratum, CAST(target AS INTEGER) AS target, least(target, coalesce(n, 0)) AS actual FROM t LEFT JOIN (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1) USING (stratum)""")
def sample_targets(spark: SparkSession, d: str) -> DataFrame:
    quotas = {"BUILDING": 30, "MACHINERY": 100_000, "NONE": 4}
    picked = sampling.non_overlapping(_customers(spark, d), "c_custkey", "c_mktsegment", quotas, 7)
    return sampling.sample_counts(picked, "c_mktsegment", quotas)


@query("""SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) WHEN 0 THEN 'P' WHEN 1 THEN 'F' ELSE min(CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN o_orderstatus END) END AS o_orderstatus FROM orders GROUP BY 1""")
def merged_statuses(spark: SparkSession, d: str) -> DataFrame:
    return sampling.merged_actions(sources.table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["P", "F"])


@query("""WITH c AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) // 20 + 1 AS chunk_id FROM customer)
SELECT g AS c_mktsegment, min(chunk_id) AS chunk_id FROM (SELECT chunk_id, min(c_mktsegment) AS g FROM c GROUP BY 1 HAVING count(*) = 20 AND count(DISTINCT c_mktsegment) = 1) GROUP BY 1""")
def pure_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = panel.chunks(_customers(spark, d).select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"], 20)
    return sampling.first_pure_chunk(c, "chunk_id", "c_mktsegment", 20)


@query("SELECT row_number() OVER (ORDER BY p_name) - 1 AS n, p_name FROM (SELECT DISTINCT p_name FROM part)")
def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    from panelkit.operators.ordered import sorted_unique

    return sorted_unique(sources.table(spark, d, "part"), "p_name")


# -- rows and columns ------------------------------------------------------------------------------


@query(f"WITH {_DUP} SELECT DISTINCT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM dup")
def distinct_orders(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.distinct_rows(_duplicated(spark, d).withColumn("o_totalprice", F.col("o_totalprice").cast("double")))[0]


@query(f"WITH {_DUP} SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dup)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup)) AS n_removed FROM dup")
def removed_orders(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.distinct_rows(_duplicated(spark, d))[1]


@query("""SELECT 'customer' AS piece, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, NULL AS phone FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL, NULL FROM supplier""")
def all_parties(spark: SparkSession, d: str) -> DataFrame:
    """Two tables under canonical names, each from the first of its aliases, and one under the other; what neither has is null."""
    aliases = {"id": ["key", "c_custkey", "s_suppkey"], "name": ["c_name", "s_name"], "nation": ["c_nationkey", "s_nationkey"], "balance": ["c_acctbal", "s_acctbal"], "phone": ["c_phone"]}
    types = {"id": "long", "nation": "int", "balance": "double"}
    c, s = _customers(spark, d), sources.table(spark, d, "supplier")
    return panel.aligned_union({"customer": cleaning.first_of(c, aliases | {"segment": ["c_mktsegment"]}, types), "supplier": cleaning.first_of(s, aliases, types)})


@query("""SELECT 'c_custkey' AS "column", count(c_custkey) AS non_null, 'id' AS target, 'exact' AS status FROM customer UNION ALL SELECT 'c_name', count(c_name), 'name', 'contains' FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), NULL, 'unmatched' FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal), NULL, 'unmatched' FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), 'segment', 'contains' FROM customer""")
def customer_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by name, by terms, ambiguous (two have 'key') or not at all."""
    targets = {"id": (["c_custkey"], []), "name": (["name"], ["name"]), "key": ([], ["key"]), "segment": ([], ["mkt", "seg"]), "phone": (["phone"], ["phone"])}
    return cleaning.column_inventory(_customers(spark, d).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), targets)


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS o_orderpriority FROM orders""")
def mapped_priorities(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high"), ("5-LOW", "low")], "alias string, canonical string")
    return cleaning.mapped(sources.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", mapping)


@query("""SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, CAST(l_quantity AS DOUBLE) AS original, 'set to null' AS action FROM lineitem WHERE l_quantity IN (1, 50)
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', CAST(l_discount AS DOUBLE), 'set to null' FROM lineitem WHERE l_discount = 0""")
def sentinel_log(spark: SparkSession, d: str) -> DataFrame:
    clean, log = cleaning.sentinels_to_null(sources.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": [1.0, 50.0], "l_discount": [0.0]})
    contracts.assert_none(clean, {"a sentinel is left": F.col("l_quantity").isin(1.0, 50.0) | (F.col("l_discount") == 0)})
    return log


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE month(o_orderdate) = 12 AND day(o_orderdate) = 31 AND year(o_orderdate) BETWEEN 1992 AND 1998 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)""")
def year_end_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a year's last day, but for customers on an exclusion list."""
    out = _customers(spark, d).where("c_acctbal < -500").select(F.col("c_custkey").alias("o_custkey"))
    return cleaning.without(cleaning.period_end(sources.table(spark, d, "orders"), "o_orderdate", (1992, 1998)), out, ["o_custkey"]).select("o_orderkey", "year")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n, any_value(CAST(o_totalprice AS DOUBLE)) AS price FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n, any_value(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN o.n = 1 THEN price END AS price, CASE WHEN e.n = 1 THEN value END AS value, coalesce(o.n = 1, false) AS has_orders, coalesce(e.n = 1, false) AS has_events,
  nullif(concat_ws(';', CASE WHEN o.n IS NULL THEN 'orders_missing' WHEN o.n > 1 THEN 'orders_ambiguous' END, CASE WHEN e.n IS NULL THEN 'events_missing' WHEN e.n > 1 THEN 'events_ambiguous' END), '') AS failure_reason
FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey""")
def customer_statements(spark: SparkSession, d: str) -> DataFrame:
    """What each of two sources says of a customer, where it says one thing."""
    orders = sources.table(spark, d, "orders").where("year(o_orderdate) = 1995").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").cast("double").alias("price"))
    events = sources.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "value")
    return cleaning.statement_rows(_customers(spark, d).select(F.col("c_custkey").alias("k")), {"orders": (orders, ["price"]), "events": (events, ["value"])}, ["k"])


# -- audits ----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY ALL HAVING count(*) > 1), o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice, o_orderstatus FROM orders)
SELECT o_orderkey, 'open_and_old' AS error FROM o WHERE o_orderstatus = 'O' AND day < DATE '1993-01-01' UNION ALL SELECT o_orderkey, 'price' FROM o WHERE o_totalprice < 20000 UNION ALL SELECT o_orderkey, 'same_day' FROM o JOIN m USING (o_custkey, day)""")
def order_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rules that a manifest's rows break, and keys that repeat, a row each."""
    o = sources.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    rules = {"open_and_old": (F.col("o_orderstatus") == "O") & (F.col("day") < F.lit("1993-01-01").cast("date")), "price": F.col("o_totalprice") < 20000}
    return contracts.structural_errors(o, rules, {"same_day": ["o_custkey", "day"]}).select("o_orderkey", "error")


@query("""SELECT field, count(x) AS n, round(count(x) / count(*), 6) AS coverage, count(*) FILTER (WHERE isinf(x)) AS infinite, count(*) FILTER (WHERE x <= 0) AS nonpositive
FROM (SELECT 'c_acctbal' AS field, CAST(c_acctbal AS DOUBLE) AS x FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer) GROUP BY 1""")
def customer_field_quality(spark: SparkSession, d: str) -> DataFrame:
    return audits.field_quality(_customers(spark, d), ["c_acctbal", "c_nationkey"]).withColumn("coverage", r("coverage"))


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS ok_errors, count(*) FILTER (WHERE NOT cheap) AS cheap_errors, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS groups
FROM (SELECT o_orderpriority, o_orderstatus, o_orderstatus <> 'O' AS ok, o_totalprice < 100000 AS cheap FROM orders) GROUP BY 1""")
def priority_causes(spark: SparkSession, d: str) -> DataFrame:
    o = sources.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_orderstatus") != "O").alias("ok"), (F.col("o_totalprice") < 100000).alias("cheap"))
    return audits.cause_summary(o, "o_orderpriority", ["ok", "cheap"], "o_orderstatus")


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS sampled, count(*) FILTER (WHERE c_acctbal > 0) AS valid, count(*) FILTER (WHERE c_nationkey < 10) AS reviewed FROM customer WHERE c_nationkey IN (2, 3, 5, 11) GROUP BY 1)
SELECT c_mktsegment, count(*) AS population, coalesce(any_value(sampled), 0) AS sampled, coalesce(any_value(valid), 0) AS valid, coalesce(any_value(reviewed), 0) AS reviewed FROM customer LEFT JOIN s USING (c_mktsegment) GROUP BY 1""")
def segment_samples(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).withColumns({"valid": F.col("c_acctbal") > 0, "reviewed": F.col("c_nationkey") < 10})
    return audits.sample_matrix(c, c.where(F.col("c_nationkey").isin(2, 3, 5, 11)), ["c_mktsegment"], ["c_custkey"], "valid", "reviewed")


@query("""SELECT count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'P') THEN o_custkey END) AS n_success, count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT' THEN o_custkey END) AS n_stale FROM orders""")
def stale_orders(spark: SparkSession, d: str) -> DataFrame:
    return audits.stale(sources.table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "P"], "o_orderpriority", "1-URGENT")


@query("""SELECT l_orderkey, count(*) AS members, count(o_orderstatus) AS present, bool_and(coalesce(o_orderstatus IN ('F', 'P') AND o_orderstatus <> 'P', false)) AS complete
FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 50000) ON o_orderkey = l_orderkey GROUP BY 1""")
def order_completeness(spark: SparkSession, d: str) -> DataFrame:
    lines = sources.table(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("o_orderkey"))
    orders = sources.table(spark, d, "orders").where("o_totalprice > 50000").select("o_orderkey", "o_orderstatus")
    return audits.chunk_completeness(lines, orders, "l_orderkey", "o_orderkey", "o_orderstatus", ["F", "P"], ["P"])


# -- sources and classes ---------------------------------------------------------------------------


@query("""SELECT page_id, CAST(CASE WHEN page_id IN (3, 4) THEN 1 WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 2 WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 3 ELSE 4 END AS INTEGER) AS tier
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)""")
def page_tiers(spark: SparkSession, d: str) -> DataFrame:
    pages = sources.table(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", text.source_tier(F.col("url"), F.col("page_id"), {1: [3, 4]}, {"example.org": 2, "example.net": 3}, 4).alias("tier"))


@query("""WITH p AS (SELECT page_id, url, starts_with(url, 'https://') AS secure, regexp_extract(url, '/([a-z]+)/', 1) AS section, html FROM pages)
SELECT page_id, CASE WHEN NOT secure THEN 'NOT_OFFICIAL' WHEN NOT contains(html, 'lang="' || section || '"') THEN 'WRONG_ISSUER' WHEN NOT contains(url, '2') THEN 'WRONG_YEAR' WHEN length(html) < 3000 OR lower(url) LIKE '%summary%' THEN 'SUMMARY' ELSE 'VERIFIED_FULL_REPORT' END AS identity FROM p""")
def page_identities(spark: SparkSession, d: str) -> DataFrame:
    p = sources.table(spark, d, "pages").withColumn("section", F.regexp_extract("url", "/([a-z]+)/", 1))
    issuer = F.col("html").contains(F.concat(F.lit('lang="'), F.col("section"), F.lit('"')))
    return p.select("page_id", evidence.source_identity(F.col("url").startswith("https://"), issuer, F.col("url").contains("2"), F.length("html") >= 3000, F.col("url")).alias("identity"))


@query("""SELECT doc_id, CASE WHEN source = 'web0' THEN 'CURRENT' WHEN quality IS NULL THEN 'INSUFFICIENT' WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM documents LEFT JOIN labels USING (doc_id)""")
def document_risks(spark: SparkSession, d: str) -> DataFrame:
    docs = evidence.enriched(sources.table(spark, d, "documents").select("doc_id", "source"), [(sources.table(spark, d, "labels"), ["doc_id"])])
    kind = F.when(F.col("quality") == 0, "weak").when(F.col("quality").isNotNull(), "strong")
    return docs.select("doc_id", evidence.stale_risk(F.col("source"), "web0", F.col("toxic") == 1, kind).alias("risk"))


@query("""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations), h AS (SELECT conv_id, turn, l, i, trim(l[i]) AS x, CASE WHEN starts_with(trim(l[i]), 'The') THEN 0 ELSE 1 END AS k FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l) WHERE starts_with(trim(l[i]), 'The') OR starts_with(trim(l[i]), 'An')),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, i) AS r FROM h)
SELECT conv_id * 100 + turn AS doc, CASE k WHEN 0 THEN 'The' ELSE 'An' END AS label, trim(regexp_replace(x[CASE k WHEN 0 THEN 4 ELSE 3 END:], '^[:\\s]*', '')) AS value, CAST(i AS INTEGER) AS line FROM b WHERE r = 1 AND trim(regexp_replace(x[CASE k WHEN 0 THEN 4 ELSE 3 END:], '^[:\\s]*', '')) <> ''""")
def labelled_turns(spark: SparkSession, d: str) -> DataFrame:
    """What follows the first line that begins with a label, where it stands on that line."""
    turns = sources.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), "text")
    out = text.labelled_values(turns, "doc", "text", ["The", "An"])
    first = out.join(turns, "doc").where(F.trim(F.get(F.split("text", "\n"), F.col("line") - 1)) != F.col("label"))
    return first.select("doc", "label", "value", "line").where("value is not null")


@query("""SELECT o_orderkey, year(o_orderdate) IN (1992, 1993) OR year(o_orderdate) IN (1997, 1998) AS boundary,
  CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-03-31' AS inside FROM orders""")
def order_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Years at which an entity begins or ends, and dates in a url's path inside a notice window."""
    o = sources.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    begin, end = F.lit("1992-05-01").cast("date"), F.lit("1997-02-01").cast("date")
    url = F.concat(F.lit("https://h/"), F.date_format("day", "yyyy-MM-dd"), F.lit("/x.pdf"))
    return o.select("o_orderkey", panel.boundary_year(F.year("day"), begin, end).alias("boundary"), panel.in_notice_window(url, F.lit(1995)).alias("inside"))
