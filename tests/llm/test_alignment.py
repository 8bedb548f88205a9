"""Alignment against a plain count over tokens, encoders against their libraries, bitmaps against sets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import alignment, queries, tokens  # noqa: E402
from panelkit.llm.shared import shared_dir  # noqa: E402

PARTS = ["the", " ", "  ", "\n", "\t", "\r\n", "a", "Wor", "LD", "é", "é", "́", "İ", "ß", "中文", "😀", "🏳️‍🌈", "ﬁ", "\xa0", "　", "\x1c", "'s", " 'T", "123", "½", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "▁", "...", "!?", "​", "\x00", "̸", "<", "한국", "aaaa", "    "]


def strange(rng, most=30):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def test_encoders_equal_their_libraries(sides):
    from tokenizers import Tokenizer

    a, b = sides
    w = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    mine = tokens.Encoder(queries.tokenizer_path(), plain=True), tokens.PieceEncoder(queries.tokenizer_path("piece_bpe_32k.model")), tokens.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = [strange(rng) for _ in range(3000)]
    assert [x.tolist() for x in mine[0]([f" {t}" for t in texts])] == [a.encode(f" {t}", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in mine[1]([t and f" {t}" for t in texts])] == [b.encode(t) for t in texts]
    assert [x.tolist() for x in mine[2](texts)] == [w.encode(t, add_special_tokens=False).ids for t in texts]


def test_bitmaps():
    rng = np.random.default_rng(0)
    for docs in (1, 7, 64, 3000, 1 << 15):
        sets = [np.unique(rng.integers(0, docs, rng.integers(0, docs + 1) if i % 3 else 3)) for i in range(9)]
        made = alignment.compressed(np.repeat(np.arange(9), list(map(len, sets))), np.concatenate(sets), 9, docs)
        which, doc = alignment.expanded(made.cast(pa.binary()))
        assert [sorted(doc[which == i].tolist()) for i in range(9)] == [s.tolist() for s in sets]


def plain(rows, sides):
    """The contract, document by document."""
    a, b = sides
    keep = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte = keep | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in keep.values())}
    docs, holds = [], Counter()
    for doc, text in rows:
        said = f" {text}".encode() if text else b""
        ia, ib = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if b"".join(ta) != said or b"".join(tb) != said:
            ia, ib, ta, tb = [], [], [], []
        ea, eb = np.cumsum(list(map(len, ta))).tolist(), np.cumsum(list(map(len, tb))).tolist()
        groups = defaultdict(lambda: ([], []))
        ends = sorted(set(ea) & set(eb))
        for side, (ids, e) in enumerate(((ia, ea), (ib, eb))):
            for i, x in zip(ids, e, strict=True):
                groups[next(k for k in ends if k >= x)][side].append(i)
        made = [groups[k] for k in ends]
        links = Counter((x, y) for g in made for x in g[0] for y in g[1])
        holds.update(links.keys())
        docs.append((doc, len(ia), len(ib), made, links))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    for doc, na, nb, made, links in docs:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in made)
        yield (doc, na, nb, len(made), sum(links.values()), sum(n for k, n in links.items() if holds[k] == top[k[0]]), sum(n * holds[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if made else "")


def table():
    rng = random.Random(9)
    rows = [(i, strange(rng, 60)) for i in range(150)] + [(200 + i, " ".join(rng.choice(("one", "two", "of three", "naïve")) for _ in range(30))) for i in range(60)]
    return [*rows, (300, None), (301, ""), (302, " "), (303, "same"), (303, "same"), (303, "other"), (None, "without an id"), (None, None), (304, "😀한" * 60)]


@pytest.mark.parametrize("links", [1 << 21, 40])
def test_align(spark, sides, links):
    docs = [(i, t, "own", 3) for i, t in table()]
    df = spark.createDataFrame(docs, "doc_id long, text string, groups string, range int").repartition(3)
    got = alignment.align(df, byte_path=queries.tokenizer_path(), piece_path=queries.tokenizer_path("piece_bpe_32k.model"), most_links=links, fold=queries._sha256)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = sorted(plain(table(), sides), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_large_groups_are_counted_by_distinct_ids(sides, monkeypatch):
    aligner = alignment.Aligner(queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"))
    texts = [strange(random.Random(i), 80) for i in range(40)]
    want = alignment.Slice(aligner, texts).links()
    monkeypatch.setattr(alignment, "_LARGE", 1)
    got = alignment.Slice(aligner, texts).links()
    assert all((x == y).all() for x, y in zip(got, want, strict=True)) and want[1].max() > 1


def test_pair_counts(spark, sides):
    df = spark.createDataFrame([(1, "a a a"), (2, "a b"), (3, "b")], "doc_id long, text string")
    a, b = sides
    x, y = a.encode(" a").ids[0], b.encode("a")[0]
    made = alignment.index(df, byte_path=queries.tokenizer_path(), piece_path=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in alignment.pair_counts(made).collect()}
    assert got[x, y] == (2, 4, True)


def test_query_and_empty_table(spark, sides):
    path = shared_dir(spark)
    rows = table()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{path}/documents.parquet")
    got = queries.op12_alignment(spark, path)
    assert "groups_sha256" in got.columns and got.count() == len(rows)
    empty = shared_dir(spark)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert queries.op12_alignment(spark, empty).count() == 0
