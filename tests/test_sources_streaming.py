"""Readers and writers on files of a temporary folder; streams give what the same rows give as a batch."""

import datetime
import json
import os
import random

from pyspark.sql import functions as F

from panelkit import sources, streaming

SF = "/root/testdata/sf0.001"


def test_panel_round_trip(spark, tmp_path):
    orders = sources.table(spark, SF, "orders").withColumn("year", F.year("o_orderdate"))
    sources.write_panel(orders, f"{tmp_path}/panel", "year")
    back = spark.read.parquet(f"{tmp_path}/panel").select(orders.columns)
    assert back.exceptAll(orders).count() == 0 and orders.exceptAll(back).count() == 0
    plan = spark.read.parquet(f"{tmp_path}/panel").where("year = 1995")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_strings_keep_zeros_blanks_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿code,name,note\n000012,"a ""b"", c",\n7,"two\nlines",NA\n'.encode())
    got = sources.read_strings(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [("000012", 'a "b", c', ""), ("7", "two\nlines", "NA")]
    assert got[0].asDict().keys() == {"code", "name", "note"}
    sources.write_csv(spark.createDataFrame(got), f"{tmp_path}/out")
    again = sources.read_strings(spark, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in again.select("code", "name").collect()) == [("000012", 'a "b", c'), ("7", "two\nlines")]


def test_record_cache_keeps_the_latest_and_skips_broken_files(spark, tmp_path):
    for name, rows in (("a", [{"k": 1, "v": "old", "at": "2020"}, {"k": 2, "v": "x", "at": "2020"}]), ("b", [{"k": 1, "v": "new", "at": "2021"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "broken.json").write_text('{"records": [')
    (tmp_path / "other.json").write_text('{"nothing": 1}')
    got = sources.read_record_cache(spark, str(tmp_path), "k: int, v: string, at: string", ["k"], "at")
    assert sorted(tuple(r) for r in got.select("k", "v").collect()) == [(1, "new"), (2, "x")]


def test_requests_lose_their_secrets(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"time": "2024-01-01T00:00:00Z", "url": "https://a.example/x?token=abc&q=1", "status": 200, "outcome": "ok", "attempt": 1}\n')
    got = sources.read_requests(spark, str(tmp_path)).first()
    assert "abc" not in got.url and "q=1" in got.url and got.status == 200


def test_documents_and_export(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    doc = sources.read_documents(spark, str(tmp_path / "d")).first()
    assert (doc["size"], doc.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    df = spark.createDataFrame([(None, True, [1, 2], 1)], "a string, b boolean, c array<int>, a_name_of_more_than_twelve int")
    out = sources.export_ready(df, 12)
    assert out.columns == ["a", "b", "c", "a_name_of_mo"] and tuple(out.first()) == ("", 1, "[1,2]", 1)


def _stream(spark, tmp_path, df, files=3):
    """``df`` as a stream of some files, one a batch, in the order of its first column."""
    rows = df.orderBy(df.columns[0]).collect()
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def _events(spark):
    return sources.table(spark, SF, "events").select("event_id", "user_id", "ts", "event_type", "value")


def test_upsert_keeps_the_latest_row_of_each_key(spark, tmp_path):
    events = _events(spark)
    stream = _stream(spark, tmp_path, events)
    streaming.upsert_latest(stream, f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp", 8).awaitTermination()
    assert streaming.latest_version(spark, f"{tmp_path}/out") == 2
    got = streaming.read_latest(spark, f"{tmp_path}/out")
    assert got.columns == events.columns
    want = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(tuple(r) for r in got.select("user_id", "event_id").collect()) == sorted(tuple(r) for r in want.collect())


def _files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "manifest" not in d}


def test_an_upsert_writes_the_buckets_of_its_batch(spark, tmp_path):
    """After a first large batch one key changes: one bucket is written again, and the old version of it goes two batches later."""
    rows = spark.range(4000).select("id", F.lit(0).alias("stamp"), F.repeat(F.lit("x"), 200).alias("pad"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: streaming.upsert_latest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["id"], "stamp", f"{tmp_path}/cp", 16).awaitTermination()
    run()
    first = _files(f"{tmp_path}/out")
    for k in (1, 2):
        spark.createDataFrame([(7, k, "new")], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        now = _files(f"{tmp_path}/out")
        fresh = [f for f in now if f not in first and f"v={k}" in f]
        assert len({os.path.dirname(f) for f in fresh}) == 1
        assert sum(now[f] for f in fresh) < 0.3 * sum(first.values())
    got = streaming.read_latest(spark, f"{tmp_path}/out", rows.schema)
    assert got.count() == 4000 and got.where("id = 7").select("stamp", "pad").first() == (2, "new")
    gone = [f for f in first if not os.path.exists(f)]
    assert gone and len({os.path.dirname(f) for f in gone}) == 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The last batch's commit is taken away, as if the driver had died before it: the restart writes the same table."""
    events = _events(spark)
    stream = _stream(spark, tmp_path, events)
    streaming.upsert_latest(stream, f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp", 8).awaitTermination()
    want = sorted(map(str, streaming.read_latest(spark, f"{tmp_path}/out").collect()))
    for f in (f"{tmp_path}/cp/commits/2", f"{tmp_path}/cp/commits/.2.crc"):
        os.remove(f)
    again = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.upsert_latest(again, f"{tmp_path}/out", ["user_id"], "event_id", f"{tmp_path}/cp", 8).awaitTermination()
    assert streaming.latest_version(spark, f"{tmp_path}/out") == 2
    assert sorted(map(str, streaming.read_latest(spark, f"{tmp_path}/out").collect())) == want


def test_late_rows_are_compared_in_the_order_of_time(spark, tmp_path):
    """Batches of shuffled rows, none an hour late, give what the batch operator gives of all rows the watermark passed."""
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i % 5}", start + datetime.timedelta(minutes=i), rng.choice([None, "x", "y", "z"])) for i in range(600)]
    order = sorted(range(600), key=lambda i: i + rng.uniform(0, 55))
    df = spark.createDataFrame([rows[i] for i in order] + [("end", start + datetime.timedelta(days=2), "x")], "entity string, at timestamp, value string")
    parts = [[rows[i] for i in order[k : k + 60]] for k in range(0, 600, 60)] + [[("end", start + datetime.timedelta(days=2), "x")]]
    for part in parts:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streaming.ordered_changes(stream, "entity", "at", "value", "1 hour")
    found.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = streaming.value_changes(df, "entity", "at", "value")
    assert sorted(map(tuple, spark.table("ordered").collect())) == sorted(map(tuple, want.collect()))


def test_windowed_counts_equal_the_batch(spark, tmp_path):
    events = _events(spark)
    counts = streaming.outcome_counts(_stream(spark, tmp_path, events), "ts", "event_type", "1 hour", "60 days")
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = streaming.outcome_counts(events, "ts", "event_type", "1 hour", "60 days")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect()))


def test_sessions_equal_the_batch(spark, tmp_path):
    events = _events(spark)
    counts = streaming.session_counts(_stream(spark, tmp_path, events), "ts", "user_id", "2 hours", "60 days")
    counts.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = streaming.session_counts(events, "ts", "user_id", "2 hours", "60 days")
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, want.collect()))


def test_changes_carry_state_over_batches(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "b", "p"), (3, "a", None), (4, "a", "x"), (5, "a", "y"), (6, "b", "p"), (7, "a", "x"), (8, "b", "q")]
    df = spark.createDataFrame(rows, "at long, entity string, value string")
    found = streaming.changes(_stream(spark, tmp_path, df, 4), "entity", "at", "value")
    found.writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("changed").collect())) == [("a", 5, "x", "y"), ("a", 7, "y", "x"), ("b", 8, "p", "q")]
