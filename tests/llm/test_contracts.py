"""The registered queries on one awkward table of documents, against the contract worked out in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import queries, sharding, substring  # noqa: E402
from panelkit.llm.shared import shared_dir  # noqa: E402

WORDS = [f"w{i}" for i in range(300)]


def table():
    """(doc_id, text): a text of a megabyte, copies, a shared passage, blanks of all kinds, an added token, null and empty texts."""
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice(WORDS, n))
    passage = some(40)
    rows = [(i, some(int(rng.integers(3, 90)))) for i in range(40)]
    rows += [(50 + i, f"{some(4)}\t{passage}\n{some(3)}") for i in range(4)]
    rows += [(60 + i, rows[3][1]) for i in range(5)]
    rows += [(70, None), (71, ""), (72, " \n\x0b"), (73, "é.è 中文 <|endoftext|> It's  two\r\n"), (74, some(260_000)), (75, "la " * 300)]
    return rows


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_dir(spark)
    docs = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "own", 5) for i, t in table()]
    # Columns whose names the operators use themselves.
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, shard string, start long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(queries.tokenizer_path())
    return {i: fresh.encode(t or "", add_special_tokens=False).ids for i, t in table()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op1(spark, folder):
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, folder).collect()}
    assert got.keys() == {i for i, _ in table()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert got[70]["score"] == got[71]["score"]


def test_op4(spark, folder, ids):
    got = queries.op4_best_fit_packing(spark, folder).toPandas()
    for i, p in got.sort_values("piece").groupby("doc_id"):
        want = [*ids[i], 0]
        assert p["piece"].tolist() == list(range(len(p))) and p["length"].sum() == len(want)
        assert len(p) == -(-len(want) // 2048) and (p["length"].iloc[1:] == 2048).all()
        assert p["ids_crc32"].tolist() == [crc(want[s : s + n]) for s, n in zip(p["start"], p["length"], strict=True)]
    assert set(got["doc_id"]) == set(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 2048


def test_op5(spark, folder):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_substring_dedup(spark, folder).collect()}
    seen = set()
    for i, t in sorted(table()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone[k : k + 20] |= key in seen
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
        assert got[i] == (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())


def test_repeated_ids_keep_the_words_of_each_text(spark):
    """Rows of one id with other texts are documents of their own: spans of one are not cut out of the other."""
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(rng.choice(WORDS, n))
    long, other = some(30), some(40)
    rows = [(5, long), (5, "few words"), (6, f"{other} {long}"), (6, "short text"), (6, "short text"), (None, long), (7, None), (7, other)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in got), key=repr) == sorted(
        [(5, long, 30, 0), (5, "few words", 2, 0), (6, other, 70, 30), (6, "short text", 2, 0), (6, "short text", 2, 0), (None, long, 30, 0), (7, None, 0, 0), (7, "", 40, 40)], key=repr
    )


def test_op7(spark, folder):
    got = queries.op7_sharding(spark, folder).toPandas()
    text = dict(table())
    assert sorted(got["doc_id"]) == sorted(text)
    assert all(s == len((text[i] or "").encode()) + 8 and c == zlib.crc32((text[i] or "").encode()) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True))
    assert set(got["shard"]) <= set(range(24)) and set(got["law"]) == {"bytes"}
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))


def test_equal_texts_stay_in_one_shard(spark):
    rows = [(i, f"text {i} " + "x" * 90) for i in range(1200)] + [(5000 + 100 * g + i, f"group {g} " + "y" * 90) for g in range(12) for i in range(40)]
    got = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards=14).toPandas()
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    by = got.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 0.1 * by.mean() + 2 * got["size"].max()


def test_groups_larger_than_a_shard_are_divided():
    bounds = [(-(1 << 63), -(1 << 63)), (5, -(1 << 63)), (5, 0), (5, 9), (6, -(1 << 63))]
    assert len({sharding.assigned(bounds, [(10, 1), (40, 4), (40, 4), (40, 4), (10, 1)], 4)[i] for i in (1, 2, 3)}) > 1
    assert len({sharding.assigned(bounds, [(50, 1), (10, 4), (10, 4), (10, 4), (60, 1)], 4)[i] for i in (1, 2, 3)}) == 1


def test_op9(spark, folder, ids):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_token_files(spark, folder).collect()}
    start = 0
    for i in sorted(ids):
        want = [*ids[i], 2]
        assert got[i] == (start, len(want), crc(want))
        start += len(want)
    assert len(got) == len(ids)


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_minhash_dedup", "op4_best_fit_packing", "op5_substring_dedup", "op6_mixing", "op7_sharding", "op9_token_files", "op10_licenses"])
def test_empty_tables(spark, tmp_path, name):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert queries.queries()[name](spark, path).count() == 0
