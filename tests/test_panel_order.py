"""Global orders over more rows than a boundary sample holds, continuity's rules, and NFKC."""

import math

import pytest
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit import sources
from panelkit.operators import audits, panel, text


def test_row_numbers_on_eight_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 20_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.col("id").alias("other")).repartition(5)
        got = panel.row_numbers(df, ["k"]).select("k", "n").collect()
        assert sorted((r["k"], r["n"]) for r in got) == [(i, i + 1) for i in range(n)]
        again = df.withColumn("m", F.col("k") * F.col("k"))
        assert audits.spearman(again, "k", "m").first()["rho"] == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_continuity_is_each_documents_own(spark):
    """A value needs exactly one document before; the documents of one period are not merged."""
    rows = [(0, "a", 1, "x y z abc"), (1, "a", 1, "x y z abd"), (2, "a", 2, "x y z abc"), (3, "a", 3, "x y z abc"), (4, "a", 4, "x y z abc"), (5, "a", 4, "q"), (6, "a", 4, "abqq xyqq"), (7, "b", 2, "abc"), (8, "b", None, "abc"), (9, "a", 5, "abc")]
    df = spark.createDataFrame(rows, "i int, e string, p int, t string")
    for f in (text.continuity, text.expanding_continuity):
        got = {r[0]: r[3] for r in f(df, "e", "p", "t", ident="i").collect()}
        assert got.keys() == set(range(10))
        assert {k for k, v in got.items() if v is not None} == {3, 4, 6}
        assert abs(got[3] - 1) < 1e-9 and abs(got[4] - 1) < 1e-9 and 0 < got[6] < 1
        unnamed = f(df, "e", "p", "t")
        assert unnamed.columns[:2] == ["e", "p"] and sorted(str(r[2]) for r in unnamed.collect()) == sorted(map(str, got.values()))
    themes = text.theme_continuity(df, "e", "p", "t", {"a": ["a"], "q": ["q"]}, ident="i")
    assert {r[0]: r[3] for r in themes.collect() if r[3] is not None} == {3: 1.0, 4: 1.0, 5: 0.0, 6: pytest.approx(17**-0.5)}


def test_repeated_rows_count_as_documents(spark):
    """One document before, two after: N is 3, and equal rows count twice in the frequencies."""
    rows = [("a", 1, "abcd"), ("a", 2, "abcd"), ("a", 2, "abce")]
    got = sorted(r[2] for r in text.continuity(spark.createDataFrame(rows, "e string, p int, t string"), "e", "p", "t").collect() if r[2] is not None)
    # Terms in two documents or more: ab, bc, abc in all three, cd, bcd, abcd in two.
    common, rare = 3, 3 * (math.log(4 / 3) + 1) ** 2
    assert got == [pytest.approx(common / math.sqrt(common) / math.sqrt(common + rare)), pytest.approx(1)]


def test_nfkc(spark):
    df = spark.createDataFrame([("ＡＢ－１", "ab1"), ("ab1", "ab1"), (None, None), ("ﬁn é", "fin")], "t string, want string")
    assert all(r[0] == r[1] for r in df.select(fn.vector_text(F.col("t")), "want").collect())
    assert [r[0] for r in df.limit(1).select(fn.identity_key(F.col("t"))).collect()] == ["ab1"]


def test_panel_files_round_trip(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, 2000).otherwise(2001).cast("int").alias("year"))
    path = f"file://{tmp_path}/panel"
    sources.write_panel(df, path, "year")
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("id", "year").collect())) == sorted(map(tuple, df.collect()))
    assert len([f for f in back.inputFiles() if "year=2000" in f]) > 1
