"""Small operators on tables: aligned unions, exact copies, sorted files."""

import contextlib
import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import sources
from panelkit.contracts import ContractError, assert_join
from panelkit.operators import cleaning, panel


def test_aligned_union(spark):
    a = spark.createDataFrame([(1, "x", 2.5)], "id int, name string, v double")
    b = spark.createDataFrame([(2**40, True)], "id long, flag boolean")
    out = panel.aligned_union({"a": a, "b": b})
    assert dict(out.dtypes) == {"piece": "string", "id": "bigint", "name": "string", "v": "double", "flag": "boolean"}
    assert sorted(map(tuple, out.collect())) == [("a", 1, "x", 2.5, None), ("b", 2**40, None, None, True)]
    with pytest.raises(ContractError):
        panel.aligned_union({"a": a, "b": b.withColumn("name", F.lit(3))})


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (None, None)], "a int, b string")
    rows, log = cleaning.distinct_rows(df)
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.distinct().collect())) and tuple(log.first()) == (4, 3, 1)
    assert tuple(cleaning.distinct_rows(df.limit(0))[1].first()) == (0, 0, 0)


def test_sorted_files_are_in_one_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 997).alias("k"), "id")
    sources.write_sorted(df, f"{tmp_path}/out", ["k"])
    files = sorted(glob.glob(f"{tmp_path}/out/part-*.parquet"))
    got = pd.concat([pd.read_parquet(f) for f in files])
    assert len(files) > 1 and list(zip(got["k"], got["id"], strict=True)) == sorted(zip(got["k"], got["id"], strict=True)) and len(got) == 5000


@pytest.mark.parametrize(
    ("left", "right", "broken"),
    [
        ([(1, "a"), (2, "a")], [(1, "a"), (2, "a")], set()),
        ([(1, "a"), (1, "a")], [(1, "a")], {"left_unique"}),
        ([(1, "a")], [(1, "a"), (1, "a"), (2, "b")], {"right_unique", "right_within_left"}),
        ([(1, "a"), (3, "c")], [(1, "a")], {"left_within_right"}),
        ([(None, "a")], [(1, "a")], {"left_unique", "left_within_right", "right_within_left"}),
        ([(None, "a")], [(None, "a")], {"left_unique", "right_unique", "left_within_right", "right_within_left"}),
        ([], [(1, "a")], {"right_within_left"}),
        ([], [], set()),
    ],
)
def test_join_contracts_in_one_job(spark, left, right, broken):
    a, b = (spark.createDataFrame(x, "k int, s string") for x in (left, right))
    for rule in ("left_unique", "right_unique", "right_within_left", "left_within_right"):
        if rule in broken:
            with pytest.raises(ContractError):
                assert_join(a, b, ["k", "s"], [rule])
        else:
            assert_join(a, b, ["k", "s"], [rule])
    with pytest.raises(ContractError) if broken else contextlib.nullcontext() as caught:
        assert_join(a, b, ["k", "s"], ["left_unique", "right_unique", "right_within_left", "left_within_right"])
    assert not broken or str(caught.value).count(";") == len(broken) - 1
