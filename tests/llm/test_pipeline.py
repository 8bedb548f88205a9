"""The stages of the pipeline on small and awkward tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelkit.llm")
import corpus_pipeline  # noqa: E402
from panelkit.llm import toxicity  # noqa: E402
from panelkit.llm.shared import BATCH_BYTES, shared_dir, text_slices  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOCS)


def labelled(spark, rows):
    """A folder with ``rows`` of (doc_id, toxic) as its labels."""
    path = shared_dir(spark)
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_toxic_documents_are_those_op1_predicts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda df, model, name: df.withColumn(name, F.col("text").cast("double")))
    docs = frame(spark, enumerate(["0.1", "0.29", "0.3", "0.4", "0.49", "0.5", "0.9"]))
    got = corpus_pipeline.toxic(spark, docs, labelled(spark, [(0, 0)]))
    assert sorted(r["text"] for r in got.collect()) == ["0.1", "0.29"]


WORDS = [f"w{i}" for i in range(300)]


def text(seed, n=40):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_null_and_repeated_ids(spark):
    """Each stage by itself: no row is lost or multiplied for its id."""
    passage = text(99, 25)
    null = [(None, text(1)), (None, text(2)), (None, None), (None, f"{passage} n")]
    twice = [(5, text(5)), (5, text(5)), (5, text(6)), (6, None), (6, None), (7, ""), (7, "")]
    other = [(8, f"a {passage}"), (9, f"b {passage}"), (9, f"c {passage} d"), (10, passage)]
    rows = null + twice + other
    docs = frame(spark, rows)
    folder = labelled(spark, [(i, 0) for i in range(5, 11)])
    # Nothing toxic to learn from: every row stays, as often as it stands there.
    assert pairs(corpus_pipeline.toxic(spark, docs, folder)) == sorted(rows, key=str)
    ids = spark.createDataFrame([(None, "a b"), (None, "a"), (2, "b"), (2, "a b")], "id long, text string")
    assert sorted(toxicity._rows(ids, {"<a>": 0, "<b>": 1})) == [[0], [0, 1], [0, 1], [1]]

    got = pairs(corpus_pipeline.near_duplicates(spark, docs, folder))
    # 8 and the rows of 9 resemble 10 and each other.
    left = [r for r in rows if r[0] is None] + [(5, text(5)), (5, text(6)), (6, None), (7, "")]
    assert [r for r in got if r[0] not in (8, 9, 10)] == sorted(left, key=str)
    assert len(set(got)) == len(got)

    got = sorted(((i, t and " ".join(t.split())) for i, t in pairs(corpus_pipeline.repeated_passages(spark, docs, folder))), key=str)
    # Of the first of 9's rows in the order of their contents and the second, each keeps what stands around the passage.
    want = null + [(5, text(5)), (5, text(6)), (6, None), (6, None), (7, ""), (7, ""), (8, f"a {passage}"), (9, "b"), (9, "c d")]
    assert got == sorted(want, key=str)

    got = pairs(corpus_pipeline.mixed(spark, docs, folder))
    # One source, whose target is its size: each document with words once.
    assert got == sorted([r for r in rows if r[1]], key=str)

    packed = corpus_pipeline.packed(spark, docs, folder).toPandas()
    assert len(packed) == len(rows)
    assert sorted(packed["doc_id"].dropna().astype(int)) == [i for i, _ in sorted(twice + other, key=lambda r: r[0])]


def test_only_doubtful_rows_move_in_near_dedup(spark):
    """Rows that can't be copies reach the output without the join; copies go as before, and null ids stay."""
    rows = [(i, text(i)) for i in range(30)] + [(i, text(i - 100)) for i in range(100, 110)] + [(None, text(3))]
    path = shared_dir(spark)
    frame(spark, rows).write.parquet(path)
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), path)
    assert pairs(out) == sorted([r for r in rows if r[0] is None or r[0] < 100], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    assert "bitmap_construct_agg" in plan


def test_keys_do_not_depend_on_partitioning(spark):
    rows = [(i % 7 if i % 5 else None, text(i % 11)) for i in range(60)]
    a, b = (sorted(map(tuple, corpus_pipeline.keyed(frame(spark, rows).repartition(n)).select("__key", "doc_id", "text").collect())) for n in (1, 5))
    assert a == b
    assert [r[0] for r in a] == list(range(60))
    ids = [r[1] for r in a if r[1] is not None]
    assert ids == sorted(ids) and all(r[1] is None for r in a[: 60 - len(ids)])


def test_blanks_outside_of_passages_stay(spark):
    passage, again = text(1, 25), text(1, 25).replace(" ", "\n\t")
    clean = "  two  blanks\n\n\tindented line\r\n" + text(2).replace(" ", "\n") + " \n"
    rows = [(1, clean), (2, f"\tx\n{passage}  y\n"), (3, f"p\n\n  q \n{again}\n\n\tr  s\n"), (4, f"{passage}\n t {passage}"), (5, passage), (6, " \n"), (7, None)]
    docs = frame(spark, rows).withColumn("n_chars", F.when(F.col("doc_id") == 1, 7).otherwise(F.col("n_chars")).cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = {1: (clean, 7), 2: (rows[1][1], len(rows[1][1])), 3: ("p\n\n  q \n\n\n\tr  s\n", 16), 4: ("\n t ", 4), 6: (" \n", 2), 7: (None, 0)}
    assert got == want


def test_stages_bound_batches_in_bytes(spark):
    """2,000 texts of 10,000 characters were one batch of 20 MB before."""
    docs = frame(spark, [(1, "a b"), (2, "c d")])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    long = spark.range(2000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    for stage in (corpus_pipeline.toxic, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.packed):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, labelled(spark, [(1, 0)]))
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert max(got) < BATCH_BYTES * 1.1
        assert sum(got) > 2000 * 10_000


def test_what_a_task_freed_goes_back_at_its_end():
    """A worker's 200 MB of small objects, freed but for one in a thousand, stayed with it before."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [bytes(2000) for _ in range(100_000)]
    held = held[::1000]
    before = resident()
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b"])], ["text"])
    assert [b.num_rows for b in text_slices(iter([batch]))] == [3]
    assert before - resident() > 100 << 20
    assert len(held) == 100
