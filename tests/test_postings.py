"""Expanding continuity by blocks of postings: equal to the join of rows, and small on disk."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.operators import postings, text


def documents(seed=7, n=160, chars=120):
    """(key, entity, period, text): periods with several documents, gaps, empty and null texts, and a null period."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcde01创新人才"), rng.integers(1, 6))) for _ in range(60)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words, max(chars // 4, 1)))
        rows.append((i, f"e{i % 23}", int(rng.integers(0, 6)), [t, "", None, "a"][0 if i % 9 else i // 9 % 4]))
    return [*rows, (n, "e1", None, "abcabc"), (n + 1, "long", 1, "ab" * 3000), (n + 2, "long", 2, "abc" * 2000)]


def test_blocks_equal_rows(spark):
    df = spark.createDataFrame(documents(), "key int, e string, p int, t string").where("p is not null")
    for low, min_df in ((2, 2), (1, 1), (2, 5)):
        a, b = (f(df, "e", "p", "t", "v", low, 4, min_df, "key") for f in (text.expanding_continuity, text._expanding_by_rows))
        assert a.columns == b.columns == ["key", "e", "p", "v"]
        got, want = ({r["key"]: r["v"] for r in x.collect()} for x in (a, b))
        assert len(got) == df.count() and sum(v is not None for v in got.values()) > 20
        assert got == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_a_null_period_counts_for_none(spark):
    rows = documents()
    a, b = (text.expanding_continuity(spark.createDataFrame(x, "key int, e string, p int, t string"), "e", "p", "t", ident="key") for x in (rows, [r for r in rows if r[2] is not None]))
    got, want = ({r["key"]: r["continuity_expanding"] for r in x.collect()} for x in (a, b))
    assert len(got) == len(rows) and got.pop(160) is None and got == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_longer_ngrams_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "abcdefg"), (1, 2, "abcdefg")], "e int, p int, t string")
    assert {r["p"]: r["v"] for r in text.expanding_continuity(df, "e", "p", "t", "v", 2, 5).collect()} == {1: None, 2: pytest.approx(1.0)}
    assert text.expanding_continuity(df.limit(0), "e", "p", "t").collect() == []


@pytest.mark.parametrize("batch", [1 << 20, 300])
def test_sums_do_not_depend_on_batches_and_buckets(monkeypatch, batch):
    monkeypatch.setattr(postings, "_BATCH", batch)
    monkeypatch.setattr(postings, "_ROWS", 50)
    rng = np.random.default_rng(1)
    said = [*("".join(rng.choice(list("abcd"), rng.integers(0, 60))) for _ in range(90)), *[""] * 60]
    rows = [{"__doc": i, "__t": t, "__u": said[i - 1] if i % 3 else None, "__rank": i % 5, "__n": 20 * (i % 5 + 1)} for i, t in enumerate(said)]

    def found(buckets):
        made = [r for b in postings.blocks(2, 4, buckets)(iter([pa.RecordBatch.from_pylist(rows[:37]), pa.RecordBatch.from_pylist(rows[37:])])) for r in b.to_pylist()]
        assert len({r["bucket"] for r in made}) == buckets
        made = pa.RecordBatch.from_pylist(sorted(made, key=lambda r: r["bucket"]))
        out = {}
        for b in postings.sums(2)(iter([made])):
            for r in b.to_pylist():
                out[r["__doc"]] = np.add(out.get(r["__doc"], 0), [r["dot"], r["now"], r["before"]])
        return out

    counts = {r["__doc"]: dict(zip(*(x.tolist() for x in postings.terms(r["__t"], 2, 4)), strict=True)) for r in rows}
    want = {}
    for r in rows:
        if r["__u"] is not None:
            before = dict(zip(*(x.tolist() for x in postings.terms(r["__u"], 2, 4)), strict=True))

            def weights(c, r=r):
                df = {t: sum(t in counts[o["__doc"]] for o in rows if o["__rank"] <= r["__rank"]) for t in c}
                return {t: (1 + np.log(k)) * (np.log((1 + r["__n"]) / (1 + df[t])) + 1) for t, k in c.items() if df[t] >= 2}

            a, b = weights(counts[r["__doc"]]), weights(before)
            if a or b:
                want[r["__doc"]] = [sum(a[t] * b[t] for t in a if t in b), sum(x * x for x in a.values()), sum(x * x for x in b.values())]
    for buckets in (1, 7):
        got = found(buckets)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def _shuffled(spark):
    """Bytes of shuffles written by all stages so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def _written(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_postings_take_few_bytes_on_disk(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i // 4, i % 4, "".join(rng.choice(vocabulary, 100))) for i in range(600)]
    chars = sum(len(r[2]) for r in rows)
    df = spark.createDataFrame(rows, "e int, p int, t string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, had = _written(folder), set(_shuffled(spark))
    assert text.expanding_continuity(df, "e", "p", "t").agg(F.count("continuity_expanding")).first()[0] == 450
    assert _written(folder) - before + sum(v for k, v in _shuffled(spark).items() if k not in had) < 12 * chars


def test_postings_of_repeated_periods_take_few_bytes_on_disk(spark):
    """Two documents have the same one before them, and rows are named by a struct, as in repeated_turn_continuity_expanding."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(400)]
    rows = [((i // 4, i % 4), i // 4, min(i % 4, 2), "".join(rng.choice(vocabulary, 100))) for i in range(600)]
    chars = sum(len(r[3]) for r in rows)
    df = spark.createDataFrame(rows, "key struct<c:int,s:int>, e int, p int, t string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, had = _written(folder), set(_shuffled(spark))
    assert text.expanding_continuity(df, "e", "p", "t", ident="key").agg(F.count("continuity_expanding")).first()[0] == 450
    assert _written(folder) - before + sum(v for k, v in _shuffled(spark).items() if k not in had) < 12 * chars
