"""Orders, batches and components that no task holds whole, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from panelkit.contracts import ContractError
from panelkit.operators import evidence, graph, ordered, panel, sampling


def fold(names, most_items, most_chars, sep):
    """Greedy batches of sorted distinct strings, one after the other."""
    made, now = [], []
    for name in sorted(set(names), key=str.encode):
        if now and (len(now) == most_items or len(sep.join([*now, name])) > most_chars):
            made.append(sep.join(now))
            now = []
        now.append(name)
    return [*made, sep.join(now)] if now else made


def name(rng):
    return "".join(rng.choice("abéß中😀Z9") for _ in range(rng.randint(1, 9)))


@pytest.mark.parametrize("block", [5, 7, 64, 1 << 16])
def test_batches_equal_the_fold(spark, block):
    rng = random.Random(block)
    rows = [(g, name(rng)) for g, n in (("a", 700), ("b", 3), ("c", 150), ("d", 1), (None, 40)) for _ in range(n)] + [("e", None), ("a", "a")]
    df = spark.createDataFrame(rows, "g string, n string").repartition(3)
    got = ordered.batched(df, "g", "n", 5, 24, " OR ", block).collect()
    for g in ("a", "b", "c", "d", None):
        mine = sorted((r for r in got if r["group"] == g), key=lambda r: r["batch"])
        assert [r["batch"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["query"] for r in mine] == fold([n for k, n in rows if k == g and n is not None], 5, 24, " OR ")
        assert all(r["n_items"] == r["query"].count(" OR ") + 1 for r in mine)
    assert not [r for r in got if r["group"] == "e"]


def test_one_group_of_a_hundred_thousand_names(spark):
    df = spark.range(100_000).select(F.concat(F.lit("n"), F.hex(F.xxhash64("id")), F.repeat(F.lit("x"), (F.col("id") % 23).cast("int"))).alias("n"), F.lit("one").alias("g"))
    got = sorted(ordered.batched(df, "g", "n", 12, 240, " OR ", 4096).collect(), key=lambda r: r["batch"])
    assert [r["query"] for r in got] == fold([r[0] for r in df.select("n").collect()], 12, 240, " OR ")


def test_batch_limits(spark):
    df = spark.createDataFrame([("g", "abc"), ("g", "de")], "g string, n string")
    with pytest.raises(ContractError):
        ordered.batched(df, "g", "n", 5, 2)
    with pytest.raises(ValueError):
        ordered.batched(df, "g", "n", 0, 9)
    assert ordered.batched(df.limit(0), "g", "n", 5, 9).count() == 0


def test_batch_artifacts(spark):
    rows = [("1", "beta"), ("2", "beta"), ("3", "alpha"), ("3", "gamma"), ("4", None)]
    made, mapped = sampling.batch_artifacts(spark.createDataFrame(rows, "e string, n string"), "e", "n", 2, 40)
    assert [(r["batch"], r["query"]) for r in made.orderBy("batch").collect()] == [(1, "alpha OR beta"), (2, "gamma")]
    assert sorted(map(tuple, mapped.select("e", "n", "n_entities", "attribution", "batch").collect())) == [("1", "beta", 2, "collision", 1), ("2", "beta", 2, "collision", 1), ("3", "alpha", 1, "unique", 1), ("3", "gamma", 1, "unique", 2)]
    sampling.assert_batches_cover(made, spark.createDataFrame(rows, "e string, n string"), "n")


def test_sorted_unique(spark):
    words = ["b", "a", "é", "Z", "a", "中", "😀", "￼"]
    got = ordered.sorted_unique(spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "w").collect()
    assert [r["w"] for r in sorted(got)] == sorted(set(words), key=str.encode)


def test_running_max_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rng = random.Random(3)
        rows = [(g, i, rng.randint(0, 10_000), g) for g, n in (("hot", 4000), (None, 300), ("one", 1)) for i in range(n)]
        df = spark.createDataFrame(rows, "g string, i int, v int, __b string")
        got = ordered.running_max(df, ["g"], ["i"], "v", "m")
        assert got.columns == ["g", "i", "v", "__b", "m"]
        out = {(r["g"], r["i"]): r["m"] for r in got.collect()}
        for g in ("hot", None, "one"):
            most = None
            for _, i, v, _ in [r for r in rows if r[0] == g]:
                assert out[g, i] == most
                most = v if most is None else max(most, v)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overlap_in_one_large_group(spark):
    day = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 2).cast("int"))
    spans = spark.range(30_000).select(F.lit("g").alias("g"), "id", day.alias("b"), F.date_add(day, 1).alias("e"))
    apart = panel.overlapping(spans, ["g"], "id", "b", "e").first()
    late = spans.withColumn("e", F.when(F.col("id") == 7, F.lit("1900-02-01").cast("date")).otherwise(F.col("e")))
    assert not apart["has_overlap"] and panel.overlapping(late, ["g"], "id", "b", "e").first()["has_overlap"]
    open_end = spans.withColumn("e", F.when(F.col("id") == 29_999, None).otherwise(F.col("e")))
    assert not panel.overlapping(open_end, ["g"], "id", "b", "e").first()["has_overlap"]


def reach(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            stack = [n]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = n
                    stack += near[x]
    return out


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000, 1000), (None, 4), (2000, 2001), (2001, 2000), (2000, 2001)] + [(5000, 5001 + i) for i in range(200)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == reach(edges) and len(got) == len(reach(edges))
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_chain_of_events_ends_in_few_rounds(spark, monkeypatch):
    """Row i shares an announcement with row i + 1 and none with others: one event of 10,000 rows."""
    rounds = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or kept(df))
    n = 10_000
    rows = spark.range(n).select(F.lit("e").alias("e"), F.lit("o").alias("o"), F.lit("n").alias("n"), (F.col("id") / 2).cast("long").alias("a"), F.when(F.col("id") % 2 == 1, F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") / 2).cast("int"))).alias("d"), F.lit(2000).alias("y"))
    rows = rows.withColumn("d", F.coalesce("d", F.date_add(F.lit("2000-01-01").cast("date"), F.col("a").cast("int") - 1)))
    got = evidence.event_roster(rows, "e", "o", "n", "a", "d", "y", F.lit(True)).collect()
    assert [r["n_rows"] for r in got] == [n] and got[0]["conflict"]
    assert len(rounds) < 60


def test_years_need_one_source_where_it_is_asked_for(spark):
    rows = [("e", "o", "n", None, None, 2001, "u1"), ("e", "o", "n", None, None, 2001, "u2"), ("e", "o", "n", None, None, 2001, "u1 "), ("e", "o", "n", 5, None, 2001, "u3"), ("e", "o", "n", 5, None, 2001, "u4"), ("e", "o", "x", None, None, None, None)]
    df = spark.createDataFrame(rows, "e string, o string, n string, a long, d date, y int, s string")
    on = dict(entity="e", old="o", new="n", announcement="a", date="d", year="y", official=F.lit(True))
    assert sorted(r["n_rows"] for r in evidence.event_roster(df, **on).collect()) == [1, 2]
    assert sorted(r["n_rows"] for r in evidence.event_roster(df, **on, source="s").collect()) == [1, 1, 1, 1, 2]
