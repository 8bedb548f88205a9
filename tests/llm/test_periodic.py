"""Periodic runs against a plain search over all periods, and the query on an awkward table."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import periodic, queries  # noqa: E402
from panelkit.llm.shared import shared_dir  # noqa: E402


def plain(w, shortest=24, times=3):
    """All runs, by trying each period at each place."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    least = [c for c in found if not any(d[2] < c[2] and d[0] <= c[0] and d[0] + d[1] >= c[0] + c[1] for d in found)]
    return sorted(least, key=lambda r: (r[0], r[2]))


def strange(rng):
    """Words of few kinds with repeated stretches that overlap, touch and nest."""
    w = []
    for _ in range(rng.randint(0, 5)):
        part = [str(rng.randint(0, rng.randint(1, 4))) for _ in range(rng.randint(1, 14))]
        w += [part[i % len(part)] for i in range(rng.randint(1, 60))] if rng.random() < 0.6 else [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 40))]
    return w


def test_runs_equal_a_plain_search():
    rng, n = random.Random(5), 0
    for _ in range(400):
        docs = [strange(rng) for _ in range(rng.randint(1, 4))]
        shortest, times = rng.choice([(24, 3), (6, 3), (8, 4)])
        of, rows, gone = periodic.runs_of([[x.encode() for x in d] for d in docs], shortest, times)
        begin = 0
        for k, d in enumerate(docs):
            want = plain(d, shortest, times)
            assert [tuple(r) for o, r in zip(of.tolist(), rows.tolist(), strict=True) if o == k] == want
            inside = {i for s, length, q in want for i in range(s + q, s + length)}
            assert [i for i in range(len(d)) if gone[begin + i]] == sorted(inside)
            begin, n = begin + len(d), n + len(want)
    assert n > 300


def test_splitting_leaves_every_word_of_a_run():
    rng = random.Random(6)
    w = [str(rng.randint(0, 400)) for _ in range(3000)] + ["a", "b", "c"] * 9 + [str(rng.randint(0, 400)) for _ in range(3000)]
    of, rows, _ = periodic.runs_of([[x.encode() for x in w]])
    assert [tuple(r) for r in rows.tolist()] == plain(w) == [(3000, 27, 3)]


@pytest.mark.parametrize("words", [["x"] * 300_000, [str(i % 7919) for i in range(300_000)], [str(bin(i).count("1")) for i in range(300_000)]])
def test_long_texts_take_n_log_n(words):
    of, rows, _ = periodic.runs_of([[x.encode() for x in words]])
    assert len(rows) == (words[0] == words[1] or words[7919] == "0")


def test_times_below_three_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.collapse(spark.createDataFrame([], "doc_id long, text string"), times=2)


def table():
    rng = random.Random(7)
    rows = [(i, " ".join(strange(rng))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\x0b\x1c"), (203, "la " * 40), (203, "la " * 40), (203, "é è " * 30), (None, "ha ha\tho\n" * 12), (204, " ".join(str(rng.randint(0, 30_000)) for _ in range(200_000)))]
    return rows


def test_op13(spark):
    path = shared_dir(spark)
    docs = [(i, t, "en", 1, "own") for i, t in table()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, runs int, w string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, path).collect()), key=repr)
    want = []
    for i, t in table():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        runs = plain(w) if len(w) < 10_000 else []
        best = next(((s, n, q) for s, n, q in runs if all(n * r[2] >= r[1] * q for r in runs)), None)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, f"file://{tmp_path}").count() == 0
