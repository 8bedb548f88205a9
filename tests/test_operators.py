"""Operators on small literal frames."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit import contracts
from panelkit import functions as fn
from panelkit.contracts import ContractError
from panelkit.operators import audits, cleaning, evidence, panel, sampling, stats, text


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [(" 000001 ", "000001"), ("2", "000002"), ("3.0", "000003"), ("1234567", "1234567"), ("12a", None), (None, None)])
def test_code(spark, raw, want):
    assert one(spark, fn.code, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1,234", 1234.0), ("-", None), ("NA", None), ("", None), (" 7 ", 7.0), ("x", None)])
def test_number(spark, raw, want):
    assert one(spark, fn.number, raw) == want


def test_percent_and_dates(spark):
    assert one(spark, fn.percent, "13.5%") == pytest.approx(0.135)
    assert one(spark, fn.percent, "13.5") == 13.5
    assert one(spark, fn.date, "2020-1-5") == datetime.date(2020, 1, 5)
    assert one(spark, fn.date, "2020/01/05") == datetime.date(2020, 1, 5)
    assert one(spark, fn.date, "43835") == datetime.date(2020, 1, 5)
    assert one(spark, fn.date, "soon") is None


def test_redaction_and_names(spark):
    assert one(spark, fn.redacted, "https://a.b/c?token=xyz&page=2") == "https://a.b/c?token=[REDACTED]&page=2"
    assert one(spark, fn.split_names, "A b→ a B →C") == ["A b", "C"]
    assert one(spark, lambda c: fn.excerpt(c, ["cat", "dog"], 3), "the big dog barks") is not None


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ContractError):
        contracts.assert_unique(df, ["k"])
    with pytest.raises(ContractError):
        contracts.require_columns(df, ["missing"])
    with pytest.raises(ContractError):
        contracts.assert_same_keys(df, df.where("v = 'c'"), ["k"])
    assert contracts.fingerprint(df, ["k", "v"]).first() == contracts.fingerprint(df.orderBy(F.desc("v")), ["v", "k"]).first()


def test_absence_is_never_zero(spark):
    a = spark.createDataFrame([(1, 2020), (1, 2021)], "f int, year int")
    b = spark.createDataFrame([(1, 2020, 5)], "f int, year int, n int")
    got = {r["year"]: (r["n"], r["record_present"]) for r in panel.with_record(a, b, ["f", "year"]).collect()}
    assert got == {2020: (5, 1), 2021: (None, 0)}
    with pytest.raises(ContractError):
        panel.lookup(a, b, ["f", "year"])


def test_as_of(spark):
    periods = spark.createDataFrame([("a", y) for y in range(2018, 2023)] + [("b", 2020)], "e string, year int")
    events = spark.createDataFrame([("a", "2019-06-01", "x", "y"), ("a", "2021-03-01", "y", "z")], "e string, d string, o string, n string")
    got = {(r["e"], r["year"]): r["v"] for r in panel.as_of(periods, events, "e", "year", "d", "o", "n", "v").collect()}
    assert [got[("a", y)] for y in range(2018, 2023)] == ["x", "y", "y", "z", "z"]
    assert got[("b", 2020)] is None


def test_expand_years(spark):
    df = spark.createDataFrame([("a", "2019-05-01", "2021-01-01"), ("b", "2020-12-31", None), ("c", None, None)], "k string, b string, e string")
    got = sorted((r["k"], r["year"]) for r in panel.expand_years(df, "b", "e", 2018, 2022).collect())
    assert got == [("a", 2019), ("a", 2020), ("b", 2020), ("b", 2021), ("b", 2022)]


def test_previous_needs_exactly_one(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("b", 1, 8), ("b", 2, 9)], "e string, p int, v int")
    got = {(r["e"], r["p"], r["v"]): r["v_previous"] for r in panel.previous(df, "e", "p", ["v"]).collect()}
    assert got[("a", 2, 6)] == 5
    assert got[("b", 2, 9)] is None


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 5.0, 0), (1, 5.0, 0), (2, 1.0, 0), (2, None, 1), (3, 2.0, 0)], "k int, v double, pos int")
    got = {r["k"]: r["kind"] for r in cleaning.duplicate_classes(df.drop("pos"), ["k"]).collect()}
    assert got == {1: "exact", 2: "conflict"}
    assert {r["k"]: r["v"] for r in cleaning.keep_fullest(df, ["k"], "pos").collect()} == {1: 5.0, 2: 1.0, 3: 2.0}


def test_sample_is_stable(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    a, b = ({r["k"] for r in sampling.stratified(d, "k", "s", {"0": 4, "1": 2}, 1).collect()} for d in (df, df.repartition(7)))
    assert a == b
    assert len(a) == 6
    with pytest.raises(ContractError):
        sampling.stratified(df, "k", "s", {"0": 400}, 1, strict=True)


def test_batches(spark):
    df = spark.createDataFrame([("g", x) for x in ("ccc", "a", "bb", "a")], "g string, n string")
    got = [(r["batch"], r["query"]) for r in sampling.batches(df, "g", "n", 2, 20).orderBy("batch").collect()]
    assert got == [(1, "a OR bb"), (2, "ccc")]


def test_preferred_evidence(spark):
    df = spark.createDataFrame([("a", "H1", "x"), ("a", "H2", "y"), ("b", "H1", "x"), ("b", "H1", "y"), ("c", "S", "z")], "e string, tier string, v string")
    got = {r["e"]: (r["v"], r["conflict"]) for r in evidence.preferred(df, ["e"], "tier", "v", ["H1", "H2", "H3", "S"]).collect()}
    assert got == {"a": ("x", True), "b": (None, True), "c": ("z", False)}


def test_continuity_against_plain_python(spark):
    docs = {("a", 1): "abcabcxyz", ("a", 2): "abcabcxyw", ("b", 1): "zzzzabc", ("b", 2): "", ("c", 5): "abcabc"}
    df = spark.createDataFrame([(k[0], k[1], t) for k, t in docs.items()], "e string, p int, t string")
    got = {(r["e"], r["p"]): r["continuity"] for r in text.continuity(df, "e", "p", "t").collect()}
    grams = {k: [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for k, t in docs.items()}
    freq = {g: sum(g in x for x in grams.values()) for x in grams.values() for g in x}

    def vector(k):
        w = {g: (1 + np.log(grams[k].count(g))) * (np.log((1 + len(docs)) / (1 + freq[g])) + 1) for g in set(grams[k]) if freq[g] >= 2}
        n = np.sqrt(sum(x * x for x in w.values()))
        return {g: x / n for g, x in w.items()}

    a, b = vector(("a", 1)), vector(("a", 2))
    assert got[("a", 2)] == pytest.approx(sum(x * b.get(g, 0) for g, x in a.items()))
    assert got[("a", 1)] is None
    assert got[("b", 2)] is None


def test_expanding_ignores_later_text(spark):
    rows = [("a", 1, "abcdabcd"), ("a", 2, "abcdxbcd"), ("b", 1, "abcdqq"), ("b", 2, "qqabzz"), ("a", 3, "zzzz")]
    a, b = ({(r["e"], r["p"]): r["continuity_expanding"] for r in text.expanding_continuity(spark.createDataFrame(x, "e string, p int, t string"), "e", "p", "t").collect()} for x in (rows, [*rows[:4], ("a", 3, "abcdabcdabcd")]))
    assert all(a[k] == b[k] for k in a if k[1] < 3)
    assert a[("a", 2)] is not None


def test_fixed_effects_against_dummies(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{i}", 2000 + t, f"g{i % 5}", float(rng.normal()), float(rng.normal())) for i in range(40) for t in range(4)]
    df = spark.createDataFrame(rows, "firm string, year int, grp string, x double, e double").withColumn("y", 0.7 * F.col("x") + F.col("e"))
    g = stats.gram(df, "y", ["x"], "firm", "year", "grp")
    p = df.toPandas()
    firm, year = p["firm"].astype("category").cat.codes.to_numpy(), p["year"].to_numpy() - 2000
    x = np.column_stack([p["x"], np.eye(40)[firm], np.eye(4)[year][:, 1:]])
    b = np.linalg.lstsq(x, p["y"].to_numpy(), rcond=None)[0]
    f = stats.fit(g)
    assert f.beta == pytest.approx(b[0], abs=1e-9)
    u = p["y"].to_numpy() - x @ b
    s = np.array([(x[p["grp"] == c].T @ u[p["grp"] == c]) for c in sorted(p["grp"].unique())])
    inv = np.linalg.pinv(x.T @ x)
    k = x.shape[1]
    v = 5 / 4 * 159 / (160 - k) * inv @ (s.T @ s) @ inv
    assert f.se == pytest.approx(np.sqrt(v[0, 0]), rel=1e-6)
    assert len(set(stats.WEBB)) == 6
    assert stats.t_p_value(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    t, pv = stats.wild_bootstrap(spark, g, reps=200)
    assert 0 <= pv <= 1
    assert set(stats.leave_one_out(g)) == {f"g{i}" for i in range(5)}


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 5), (None, 4)], "a int, b int")
    import pandas as pd

    p = pd.DataFrame({"a": [1, 1, 2, 3], "b": [1, 2, 2, 5]})
    got = audits.spearman(df, "a", "b").first()
    assert got["n"] == 4
    assert got["rho"] == pytest.approx(p["a"].rank().corr(p["b"].rank()))


def test_spearman_of_values_that_change_when_computed_again(spark):
    again = F.udf(lambda: np.random.default_rng().random(), "double").asNondeterministic()
    got = audits.spearman(spark.range(200, numPartitions=2).select(F.col("id").alias("a"), (F.col("id") + again()).alias("b")), "a", "b").first()
    assert got["n"] == 200 and got["rho"] == pytest.approx(1.0)


def test_gate_levels(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True)], "l string, m string, ok boolean")
    got = {(r["l"], r["m"]): (r["n"], r["passed"]) for r in audits.gate(df, ["l", "m"], F.col("ok"), 0.6).collect()}
    assert got[("ALL", "ALL")] == (3, True)
    assert got[("a", "ALL")] == (2, False)
    assert got[("b", "x")] == (1, True)


def test_pages(spark):
    html = "<html><nav>menu</nav><h1>Title</h1><p>Some <b>text</b> &amp; more</p><script>x()</script></html>"
    df = text.clean_pages(spark.createDataFrame([(html,), (None,)], "html string"), "html")
    assert [r["text"] for r in df.collect()] == ["Title\nSome text & more", None]
