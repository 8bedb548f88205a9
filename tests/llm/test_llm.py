"""The operators for training text against brute force, on small and awkward tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelkit.llm")
from panelkit.llm import dac, licenses, minhash, mixing, multi_index, nn_descent, packing, sharding, substring, toxicity  # noqa: E402
from panelkit.llm.queries import tokenizer_path  # noqa: E402
from panelkit.llm.shared import components, marked, shared_dir  # noqa: E402
from panelkit.llm.tokens import Encoder  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, source string, size string, shard string"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, blanks, nulls, ties, and columns whose names clash."""
    rng = np.random.default_rng(seed)
    passage = " ".join(rng.choice(WORDS, 30))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(WORDS, int(rng.integers(1, 120))))
        if i % 7 == 0:
            t = t + "\t" + passage + "\n" + " ".join(rng.choice(WORDS, 5))
        rows.append((i, t, f"s{i % 4}" if i % 9 else None, "x", "y"))
    rows += [(100 + i, rows[5][1], "s1", "x", "y") for i in range(5)]
    long = rows[8][1].split() * 3
    rows += [(200 + i, " ".join([*long[:i], "changed", *long[i:]]), "s2", "x", "y") for i in range(5)]
    return [*rows, (300, None, "s1", "x", "y"), (301, "", "s3", "x", "y"), (302, " \n\t", None, "x", "y"), (303, "la " * 200, "s0", "x", "y")]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == dict.fromkeys(range(1, 41), 1) | dict.fromkeys((100, 101, 102), 100)


def test_near_duplicates(spark):
    rows = corpus()
    got = {r["id"]: r for r in minhash.near_duplicates(frame(spark, rows), words=2).collect()}
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0]] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_repeats(spark):
    rows = corpus()
    got = {r["id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring.remove_repeats(frame(spark, rows), block_bytes=2000).collect()}
    seen = set()
    for i, t, *_ in sorted(rows):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert got[i] == (len(w), sum(gone), None if t is None else " ".join(kept))


def test_hot_minimisers_change_nothing(spark):
    rows = corpus(1)
    df = frame(spark, rows)
    want = {r["id"]: r["text"] for r in substring.remove_repeats(df).collect()}
    # Every minimiser that is counted is hot.
    assert {r["id"]: r["text"] for r in substring.remove_repeats(df, hot_rows=0).collect()} == want


def test_tokens_equal_the_library():
    e = Encoder(tokenizer_path(), most=50)
    texts = [None, "", "  two  blanks\n\nlines", "It's. a,b ... x!? é.è 中文。字", "a　b\x1cc", "<|endoftext|>", *(r[1] for r in corpus())]
    for _ in range(2):
        for t, ids in zip(texts, e(texts, group_chars=300), strict=True):
            assert ids.tolist() == (e.tokenizer.encode(t, add_special_tokens=False).ids if t else [])


def test_packing(spark):
    rows = [*corpus(), (400, " ".join(WORDS * 3), "s0", "x", "y")]
    cap = 256
    got = packing.pack(frame(spark, rows), tokenizer=tokenizer_path(), capacity=cap).toPandas()
    e = Encoder(tokenizer_path())
    want = {r[0]: [*e([r[1]])[0].tolist(), 0] for r in rows}
    for doc, p in got.sort_values("piece").groupby("doc_id"):
        assert np.concatenate([np.frombuffer(x, f"<u{n}") for x, n in zip(p["ids"], p["id_bytes"], strict=True)]).tolist() == want[doc]
        assert (p["length"].iloc[1:] == cap).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all()
        assert s["length"].sum() <= cap
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / cap + 1
    assert packing.pack(frame(spark, []), tokenizer=tokenizer_path()).count() == 0


def test_mixing(spark):
    rows = corpus()
    a, b = (mixing.mix(d).toPandas().sort_values(["doc_id"]).reset_index(drop=True) for d in (frame(spark, rows), frame(spark, rows).repartition(5)))
    assert a.equals(b)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    assert dict(zip(a["doc_id"], a["size"], strict=True)) == size
    assert (a["taken"] <= 3 * a["size"]).all()
    by = a.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), size=("size", "sum"))
    assert by["target"].sum() == pytest.approx(sum(size.values()))
    assert (by["target"] <= 3 * by["size"] + 1e-6).all()
    assert ((by["target"] - by["taken"]).abs() <= by["most"]).all()


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 100), ("d", 0), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    left, open_, total = dict.fromkeys(got, 0.0), {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, 116.0
    cap = {"a": 30, "b": 3, "c": 300, "d": 0, None: 15}
    while True:
        rest = total - sum(cap[k] for k in got if k not in open_)
        level = rest / sum(open_.values())
        over = [k for k, w in open_.items() if level * w > cap[k]]
        if not over:
            break
        for k in over:
            del open_[k]
    left = {k: level * open_[k] if k in open_ else cap[k] for k in got}
    assert got == pytest.approx(left)


def test_sharding(spark):
    rows = corpus() + [(500 + i, "same text " * 20, "s0", "x", "y") for i in range(80)]
    got = sharding.place(frame(spark, rows), shards=4).toPandas()
    assert len(got) == len(rows)
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    by = got.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 2 * got["size"].max() + by.sum() / 32
    assert sharding.place(frame(spark, [])).count() == 0


def test_token_files(spark):
    rows = corpus()
    path = shared_dir(spark)
    dac.write(frame(spark, rows), path, tokenizer=tokenizer_path(), end_id=2, segment_ids=500)
    segments = dac.read(spark.read.parquet(path))
    got = {r["d"]: (r["s"], r["n"], r["c"]) for r in dac.decoded(segments, lambda d, s, ids: (d, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "d long, s long, n long, c long").collect()}
    e, start, flat = Encoder(tokenizer_path()), 0, []
    for r in sorted(rows):
        ids = np.append(e([r[1]])[0], np.uint32(2)).astype("<u4")
        assert got[r[0]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        flat += ids.tolist()
    for at in (0, 499, 500, len(flat) - 1):
        assert dac.token_at(segments, at) == flat[at]


def test_codes_round_trip():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**32 - 1] * 300, np.uint32)
    x = dac.Image(dac.encode(ids, np.array([len(ids)])))
    assert x.all().tolist() == ids.tolist()
    assert [x[i] for i in range(0, len(ids), 37)] == ids[::37].tolist()
    assert dac.Image(dac.encode(ids[:0], np.array([0]))).all().tolist() == []


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 16))
    v[60:90] = v[0] + 0.05 * rng.normal(size=(30, 16))
    v[90:100] = v[1]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    got = {r["id"]: r for r in multi_index.near_duplicate_vectors(df, cell_rows=20, block_rows=16).collect()}
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(120)] == s.sum(1).tolist()
    label = np.arange(120)
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(120)])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in range(120)] == label.tolist()
    assert all(got[i]["kept"] and got[i]["n_links"] == 0 for i in (200, 201, 202, 203))
    near = nn_descent.nearest(df, df.where("vec_id % 10 = 0"), neighbours=16, sample=8, rounds=3, hops=3).toPandas()
    c = u @ u.T
    np.fill_diagonal(c, -2)
    hit = 0
    for q in range(0, 120, 10):
        mine = near[near["query_id"] == q].sort_values("rank")
        best = sorted(range(120), key=lambda j: (-round(c[q, j], 12), j))[:5]
        hit += len(set(best) & set(mine["id"]))
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 60


def test_licenses(spark):
    t = list(licenses.TEMPLATES.values())
    rows = [(1, f"a b c {t[0]} d e", "", "", ""), (2, f"x\n{t[2].upper()}\n{t[3]}", "", "", ""), (3, None, "", "", ""), (4, "short", "", "", ""), (5, "Licensed under the Apache Foundation of nothing at all", "", "", "")]
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, rows)).collect())
    names = list(licenses.TEMPLATES)
    assert got == sorted([(1, names[0]), (2, names[2]), (2, names[3])])
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_windows(spark):
    """Each window's minimum, with ends that no window fills; a piece that can miss no shingle needs one band."""
    lists = [[], [5], [3, -4, 9], list(range(-7, 9)), [int(x) for x in np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 37)]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(lists)], "i int, h array<long>")
    for step in (0, -1, -2, -3, 2, 4, 8):
        stride, width = (step, 2 * step) if step > 0 else (1, 1 - step)
        got = {r["i"]: r["w"] for r in df.select("i", licenses._windows(F.col("h"), step, 3).alias("w")).collect()}
        for i, h in enumerate(lists):
            x = [v ^ licenses._constant(3) for v in h]
            last = len(x) - width if step <= 0 else (-(-len(x) // stride) - 2) * stride
            want = [min(x[b : b + width]) for b in range(0, max(last, 0) + 1, stride) if x[b : b + width]]
            assert [v for v in got[i] if v is not None] == want, (step, i)
    assert [licenses.scale(n, 0.8) for n in range(1, 10)] == [0, -1, -2, -3, 4, 8, 8, 8, 8]
    assert [licenses.bands(n, 0.8, 1e-3) for n in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert licenses.scale(3, 0.5) == 2
    assert licenses.bands(3, 0.5, 1e-3) > 1


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        w = list(rng.choice(WORDS, 40))
        if i % 8 == 0:
            w[3] = "vile" + "".join(rng.choice(list("aeiou"), 2))
        rows.append((i, " ".join(w), "", "", ""))
    df = frame(spark, [*rows, (1000, None, "", "", ""), (1001, "", "", "", "")])
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 8 == 0) for i in range(500, 900))
    assert 0 <= got[1000] == got[1001] < 0.3
    nothing = toxicity.train(df, labels.where("toxic = 0"))
    assert 0 <= toxicity.score(df, nothing).agg(F.max("score")).first()[0] < 0.3


def test_digest():
    assert substring.digest("a b") == hashlib.sha256(b"a b").hexdigest()


def test_sketches_keep_links(spark):
    """Pairs at and above the threshold pass the sketches, from small sets to such as overfill the parity bits."""
    rng = np.random.default_rng(5)
    rows = []
    for n in (9, 45, 90, 450, 1800, 9000):
        for _ in range(20):
            pool = rng.integers(0, 1 << 62, n + n // 9, dtype=np.uint64)
            # n - n // 9 elements in common of n + n // 9: similarity 0.8 where 9 divides n.
            a, b = np.unique(pool[:n]), np.unique(pool[n // 9 :])
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            sketch = [np.concatenate([minhash.bits(minhash.signature(s, 240)), minhash.parity(s)]).tolist() for s in (a, b)]
            rows.append((len(a), len(b), *sketch))
    pairs = spark.createDataFrame(rows, "xn long, yn long, xb array<long>, yb array<long>")
    assert pairs.where(minhash.may_link(240, 80)).count() == len(rows)


def test_texts_of_pairs_move_once(spark):
    """One join brings a text to all places where it is compared, as an x or as a y."""
    texts = spark.read.parquet(cut_path(spark, [(1, "a b c d"), (2, "a b c d"), (3, "x y")]))
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "x long, y long")
    out = minhash.confirmed(pairs, texts, 2, 80)
    assert [tuple(r) for r in out.collect()] == [(2, 1)]
    assert out._jdf.queryExecution().sparkPlan().toString().count("text:string") == 1


def test_only_texts_of_pairs_move(spark):
    """A filter takes texts that are in no pair out before the join, whatever is broadcast otherwise."""
    ids = spark.createDataFrame([(i,) for i in (-5, 0, 7, 1 << 40, None, 7)], "key long")
    rows = spark.createDataFrame([(i, f"t{i}") for i in [-5, 0, 7, 1 << 40, None, *range(100, 1100)]], "id long, text string")
    got = marked(rows, ids, "id")
    assert got.columns == ["id", "text", "__marked"]
    got = {r["id"]: r["__marked"] for r in got.collect()}
    assert len(got) == 1005
    assert all(got[i] for i in (-5, 0, 7, 1 << 40))
    assert not got[None]
    assert sum(got.values()) < 10
    assert not marked(rows, ids.limit(0), "id").where("__marked").count()

    texts = spark.read.parquet(cut_path(spark, [(i, "a b c d") for i in range(1000)]))
    out = minhash.confirmed(spark.createDataFrame([(2, 1), (700, 1)], "x long, y long"), texts, 2, 80)
    assert sorted(tuple(r) for r in out.collect()) == [(2, 1), (700, 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    # The filter's join is below that with the places, next to the scan of the texts.
    assert plan.index("__bits") > plan.index("MapInArrow")
    assert plan.count("FileScan parquet [id") == 1


def cut_path(spark, rows):
    path = shared_dir(spark)
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    return path
