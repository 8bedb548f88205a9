"""First-fit decreasing against a plain search, and the query on an awkward table."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import group_packing, queries  # noqa: E402
from panelkit.llm.shared import shared_dir  # noqa: E402


def first_fit(lengths, capacity):
    """Each from the longest down into the first sequence with room, looked for one by one."""
    made, free = [], []
    for doc, n in sorted(enumerate(lengths), key=lambda x: (-x[1], x[0])):
        k = next((k for k, room in enumerate(free) if room >= n), len(free))
        if k == len(free):
            made.append([])
            free.append(capacity)
        made[k].append((doc, 0, n))
        free[k] -= n
    return made


def test_the_tree_finds_the_first_sequence_with_room(monkeypatch):
    monkeypatch.setattr(group_packing, "_closed", lambda made, capacity: made)
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([2, 5, 16, 100])
        lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 60))]
        assert group_packing.first_fit_decreasing(lengths, capacity) == first_fit(lengths, capacity)


def test_every_token_once_and_no_padding():
    rng = random.Random(2)
    for _ in range(500):
        capacity = rng.choice([1, 5, 16, 100])
        lengths = [rng.randint(1, rng.choice([3, capacity, 3 * capacity])) for _ in range(rng.randint(0, 50))]
        out = group_packing.first_fit_decreasing(lengths, capacity)
        sizes = [sum(p[2] for p in s) for s in out]
        assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes)
        assert sum(n < capacity for n in sizes) <= capacity.bit_length()
        assert sorted((d, x) for s in out for d, a, n in s for x in range(a, a + n)) == [(d, x) for d, n in enumerate(lengths) for x in range(n)]


def table():
    rng = np.random.default_rng(3)
    words = [f"Wörd{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 300))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "It's <|endoftext|> and\x1c<|startoftext|>İ"), (204, " ".join(rng.choice(words, 60_000))), (205, "same"), (205, "same"), (205, "other"), (None, "no id"), (None, None)]
    return rows


def test_op11(spark):
    from tokenizers import Tokenizer

    path = shared_dir(spark)
    docs = [(i, t, "own", 4) for i, t in table()]
    spark.createDataFrame(docs, "doc_id long, text string, draw string, length int").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.op11_group_packing(spark, path).toPandas()
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t in table():
        if i not in (None, 205):
            want[i] = [*library.encode(t or "", add_special_tokens=False).ids, 1]
    for i, ids in want.items():
        p = got[got["doc_id"] == i].sort_values("start")
        assert (p["start"] == p["length"].cumsum() - p["length"]).all() and p["length"].sum() == len(ids) and (p["doc_tokens"] == len(ids)).all()
        assert p["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(p["start"], p["length"], strict=True)]
    assert got["doc_id"].isna().sum() >= 2 and (got["doc_id"] == 205).sum() >= 3
    short = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = int(s["length"].sum())
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all()
        assert n == 2048 or n < 2048 and n & (n - 1) == 0
        short += n < 2048
    assert short <= 11 * 4  # of one group a partition


def test_groups_are_bounded_and_ids_come_back(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string").repartition(2)
    got = group_packing.pack(df, tokenizer=queries.tokenizer_path("word_bpe_49k.json"), group_tokens=5000, capacity=500).toPandas()
    assert (got["ids"].map(len) == got["length"] * got["id_bytes"]).all() and "folded" not in got
    assert (got.groupby("sequence_id")["length"].sum() <= 500).all()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.op11_group_packing(spark, f"file://{tmp_path}").count() == 0
