"""The nearest-neighbour search: recall against brute force, and what it does with repeated ids, ties and hubs."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import nn_descent, queries  # noqa: E402
from panelkit.llm.shared import shared_dir  # noqa: E402


def test_recall_on_twenty_thousand_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, 20_000)] + 0.6 * rng.normal(size=(20_000, 32))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": list(x)})).repartition(8)
    got = nn_descent.nearest(df, df.where("vec_id % 50 = 0")).toPandas()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -2
        found += int((rows["score"] >= np.sort(s)[-5] - 1e-9).sum())
        assert rows.sort_values("rank")["score"].tolist() == pytest.approx(sorted(s[rows["id"]], reverse=True))
    assert got["query_id"].nunique() == 400 and (got.groupby("query_id").size() == 5).all()
    assert found >= 0.9 * 2000


def test_repeated_ids_ties_and_clashing_columns(spark):
    """Of rows of one id the least vector counts in any partitioning; of equal scores the smaller ids come first."""
    rows = [(100, [1.0, 0.0], "a", 1), (100, [0.0, 1.0], "b", 2), (7, [0.0, 2.0], "c", 3), (9, [0.0, 3.0], "d", 4), (8, [0.0, 5.0], "e", 5), (3, [1.0, 0.1], "f", 6), (None, [0.0, 1.0], "g", 7), (5, None, "h", 8), (6, [0.0, 0.0], "i", 9), (4, [0.0, float("nan")], "j", 10)]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, key int").repartition(n)
        got = nn_descent.nearest(df, df.where("vec_id % 50 = 0"), k=3)
        assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()) == [(100, 1, 7, 1.0), (100, 2, 8, 1.0), (100, 3, 9, 1.0)]


def test_an_unfinished_search_is_an_error(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        nn_descent.nearest(df, df.where("vec_id % 50 = 0"), hops=1, expand=1, neighbours=4, sample=4)


def test_a_hub_gets_one_list_of_bounded_length(spark):
    """Sixty rows that all hold vector 0 send it their offers; what leaves a task is one list of four."""
    codes = [(np.array([127, i], np.int8).tobytes() + np.float32(1 / 127).tobytes()) for i in range(61)]
    rows = [([(0, -2.0, bytearray(codes[0])), (i, -2.0, bytearray(codes[i]))],) for i in range(1, 61)]
    met = spark.createDataFrame(rows, "met array<struct<other:long,worst:float,code:binary>>").coalesce(1)
    got = {r["id"]: r for r in nn_descent._local_join(met, 8, 4).collect()}
    assert sorted(got[0]["nbr"]) == [1, 2, 3, 4] and got[0]["nbr"][0] == 1


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op8_nearest_neighbours"])
def test_empty_tables(spark, name):
    path = shared_dir(spark)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    assert queries.queries()[name](spark, path).count() == 0


def test_a_pair_meets_only_while_one_of_it_is_new(spark):
    """Two that were old at a vector before are not compared and sent there again; one that is new meets all."""
    codes = [(np.array([127, i], np.int8).tobytes() + np.float32(1 / 127).tobytes()) for i in range(4)]
    kind = "met array<struct<other:long,worst:float,code:binary,fresh:boolean>>"
    for fresh, pairs in ((set(), set()), ({0}, {(0, 1), (0, 2), (0, 3)}), ({0, 1}, {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)})):
        met = spark.createDataFrame([([(i, -2.0, bytearray(codes[i]), i in fresh) for i in range(4)],)], kind)
        got = {(min(r["id"], u), max(r["id"], u)) for r in nn_descent._local_join(met, 8, 8).collect() for u in r["nbr"]}
        assert got == pairs


def test_entries_at_rest_are_sent_no_more(spark, monkeypatch):
    """Lists that are full and right from the start: after their first meeting nothing is new, and a round sends nothing."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "id long, v array<double>")
    sent = []
    join = nn_descent._local_join
    monkeypatch.setattr(nn_descent, "_local_join", lambda *a: sent.append(join(*a).count()) or join(*a))
    nn_descent.build(nn_descent.codes(df), neighbours=39, sample=39, rounds=5, changed=-1.0, sends=39)
    assert len(sent) == 5 and sent[-1] == 0
