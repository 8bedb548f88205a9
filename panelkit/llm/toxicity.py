"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; the unlabelled side is all documents, whatever their labels, as the
risk estimate takes it to be drawn from the whole. Labels of clean documents only give the class prior.
Features are words and their character n-grams that are commoner in positives than in unlabelled text;
document frequencies in unlabelled text are counted over all documents. A linear
model minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic losses by numpy on bounded
samples, and then scores every whole text where it lies.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.minhash import mix
from panelkit.llm.shared import cut, cuts, give_back, kept, text_slices

_GRAMS = (4, 5, 6)
_SLICE = 2 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)

#: A document of this score or more is predicted toxic, wherever the model is used.
THRESHOLD = 0.3


def grams(word: str) -> set[str]:
    """The word, and the n-grams of it with its bounds marked."""
    marked = f"<{word}>"
    out = {marked}
    for n in _GRAMS:
        out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, words): for each lower-case run of letters of each text its text and its place in ``words``.

    The empty word stands where a text begins or ends with something else; null texts have it alone.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL]+")
    coded = pc.list_flatten(lists).dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


class Features:
    """Ids of the known features in texts, found by 64-bit hashes of all their words' n-grams at once."""

    def __init__(self, index: dict[str, int]):
        names = list(index)
        keys = self._hashes(*self._flat(pa.array(names, pa.large_string()), ""), None) if names else np.empty(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(index.values()), np.int32)[order]
        # Where the keys of each 20 upper bits begin.
        self.begin = np.searchsorted(self.keys >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``h``, id) for the hashes that are keys, by place."""
        upper = (h >> np.uint64(44)).astype(np.int32)
        at, end = self.begin[upper], self.begin[upper + 1]
        left = np.flatnonzero(at < end)
        at, end, ids = at[left], end[left], np.full(len(h), -1, np.int32)
        while len(left):
            equal = self.keys[at] == h[left]
            ids[left[equal]] = self.ids[at[equal]]
            at += 1
            go = ~equal & (at < end)
            left, at, end = left[go], at[go], end[go]
        place = np.flatnonzero(ids >= 0)
        return place, ids[place]

    @staticmethod
    def _flat(words: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words, each between the two characters of ``mark`` if there are such, and where each begins."""
        left, right, none = (pa.scalar(x, words.type) for x in (mark[:1], mark[1:], ""))
        marked = pc.binary_join_element_wise(left, words, right, none)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), none)[0].as_py() or ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + len(mark)
        return points, np.concatenate([[0], np.cumsum(size)])

    @staticmethod
    def _hashes(points: np.ndarray, first: np.ndarray, n: int | None) -> np.ndarray:
        """Of each word, or of the ``n`` characters from each place on: differences of one running sum of powers."""
        power = np.full(len(points) + 1, np.uint64(_STEP))
        power[0] = 1
        power = np.cumprod(power)[:-1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power)])
        back = np.full(len(points) + 1, np.uint64(_BACK))
        back[0] = 1
        back = np.cumprod(back)
        if n is None:
            return mix((total[first[1:]] - total[first[:-1]]) * back[first[:-1]])
        return mix((total[n:] - total[:-n]) * back[: len(points) - n + 1])

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the features of each word, one word after the other."""
        points, first = self._flat(words, "<>")
        size = np.diff(first)
        of = np.repeat(np.arange(len(size)), size)
        left = np.repeat(first[1:], size) - np.arange(len(points))  # characters from here to the word's end
        kinds = []
        for n in (None, *_GRAMS):
            if n is None:  # words that are as long as an n-gram are found as one
                at = np.flatnonzero(~np.isin(size, _GRAMS))
                word, h = at, self._hashes(points, first, None)[at]
            elif len(points) < n:
                continue
            else:
                at = np.flatnonzero(left[: len(points) - n + 1] >= n)
                word, h = of[at], self._hashes(points, first, n)[at]
            place, ids = self._found(h)
            kinds.append((word[place], ids))
        sizes = [np.bincount(w, minlength=len(size)) for w, _ in kinds]
        ends = np.cumsum(sum(sizes, np.zeros(len(size), np.int64)))
        first = np.concatenate([[0], ends])
        out, at = np.empty(first[-1], np.int32), first[:-1].copy()
        for (w, ids), n in zip(kinds, sizes, strict=True):
            out[at[w] + np.arange(len(w)) - (np.cumsum(n) - n)[w]] = ids
            at += n
        return out, first

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, features): those of text i stand from bounds[i] to bounds[i + 1]; some come more than once."""
        text, code, words = words_of(texts)
        ids, first = self.of_words(words)
        n = np.diff(first)[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = ends[np.searchsorted(text, np.arange(len(texts) + 1))]
        some = n > 0
        n, start = n[some], first[code[some]]
        return bounds, ids[np.repeat((start - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(bounds[-1], dtype=np.int32)]


@dataclass
class Model:
    """index: feature to column; weights; bias. ``prior`` is the share of toxic documents that it was fitted with."""

    prior: float
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def sampled(key: str, rows: int, total: int) -> Column:
    """Whether a row's key falls in a hashed sample of about ``rows`` of ``total``: the same rows in every run."""
    share = min(1.0, rows / max(total, 1))
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def _document_frequencies(texts: DataFrame, index: dict[str, int]) -> np.ndarray:
    """In how many of ``texts`` each feature occurs; tasks send one row a feature that they met."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = kept((key,), lambda: Features(index)), np.zeros(len(index), np.int64)
        for b in text_slices(batches, most=_SLICE):
            bounds, feature = of(b["text"])
            for x, y in pairwise(bounds.tolist()):
                n[feature[x:y]] += 1  # by one, however often a feature stands there
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], ["feature", "n"])

    out = np.zeros(len(index), np.int64)
    for r in texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():  # as many as features
        out[r[0]] = r[1]
    return out


def _distinct(bounds: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) once each, in order; text i's stand between its bounds and are below ``n``."""
    pair = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * max(n, 1) + feature)
    return pair // max(n, 1), pair % max(n, 1)


def _rows(texts: DataFrame, index: dict[str, int]) -> list[list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(index)
        for b in text_slices(batches, most=_SLICE):
            text, feature = _distinct(*of(b["text"]), len(index))
            ends = np.searchsorted(text, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))], ["id", "x"])

    rows = texts.select("id", "text").mapInArrow(run, "id long, x array<int>").collect()
    return [r["x"] for r in sorted(rows, key=lambda r: (r["id"] is not None, r["id"] or 0, r["x"]))]


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n: int, prior: float, *, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; Adam over batches, each with both kinds in proportion."""
    rng = np.random.default_rng(seed)
    w, m, v, step = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    w[n] = np.log(prior / (1 - prior))

    def flat(rows: list[list[int]], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(rows[i]) for i in pick]
        return np.repeat(np.arange(len(pick)), sizes), np.fromiter((c for i in pick for c in rows[i]), np.int64, sum(sizes))

    def margins(rows: list[list[int]], pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = flat(rows, pick)
        return np.bincount(r, w[c], len(pick)) + w[n], r, c

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def pulled(g: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.bincount(c, g[r], n + 1)
        out[n] = g.sum()
        return out

    batches = max(1, -(-len(unlabelled) // 4000))
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for p, u in zip(ps, us, strict=True):
            if not len(p) or not len(u):
                continue
            zp, rp, cp = margins(positive, p)
            zu, ru, cu = margins(unlabelled, u)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # d log(1 + e^z) = sigmoid(z); d log(1 + e^-z) = sigmoid(z) - 1
            g_negative = pulled(sigmoid(zu) / len(u), ru, cu) - pulled(prior * sigmoid(zp) / len(p), rp, cp)
            if negative >= 0:
                g = pulled(prior * (sigmoid(zp) - 1) / len(p), rp, cp) + g_negative
            else:  # the estimate of a risk that can't be negative overfits: step back from it
                g = -g_negative
            g = g + decay * np.append(w[:n], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, *, most_positive: int = 4000, most_unlabelled: int = 30_000, least_lift: float = 2.5, least_evidence: float = 28.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 0) -> Model:
    """Fit on hashed samples of about ``most_positive`` toxic and ``most_unlabelled`` of all documents.

    ``labels`` holds the labels that may be learned from; its null labels and ids count as none. Documents of
    several labels are toxic if one is. Without a toxic document with a text the model knows only the prior.
    Every feature of two and one in two hundred positives at least is counted in all documents, and no text is
    shuffled. A feature counts if it is ``least_lift`` times commoner in toxic documents than in all, and its count there has a
    log-likelihood ratio of ``least_evidence`` against chance, as thousands of features are tried; all that do are kept.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(max(toxic / n if n else 0.0, 1e-4), 0.9)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # About ``most_positive`` ids, whatever the input.
    positive = cut(texts.join(F.broadcast(known.where("y = 1").where(sampled("id", most_positive, toxic)).select("id")), "id", "left_semi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in text_slices(batches):
            text, code, words = words_of(b["text"])
            of, bounds = [grams(w) if w else set() for w in words.to_pylist()], np.searchsorted(text, np.arange(b.num_rows + 1))
            for x, y in pairwise(bounds.tolist()):
                c.update(set().union(*[of[k] for k in set(code[x:y].tolist())]))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["feature", "n"])

    n_positive = positive.count()
    least = max(2, n_positive // 200)
    found = positive.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Of one sampled document in two hundred at least: a few ten thousand, whatever the input.
    in_positive = dict(sorted(map(tuple, found.collect())))
    names = list(in_positive)
    if not names:
        return Model(prior)
    n_unlabelled = texts.count()
    p, u = np.array([in_positive[x] for x in names]), _document_frequencies(texts, {x: i for i, x in enumerate(names)})
    expected = n_positive * (u + 1) / (n_unlabelled + 1)
    lift = p / expected
    evidence = 2 * (p * np.log(lift) - (p - expected))
    order = sorted(np.flatnonzero((lift >= least_lift) & (evidence >= least_evidence)).tolist(), key=lambda i: (-evidence[i], names[i]))
    index = {names[i]: k for k, i in enumerate(order)}
    if not index:
        return Model(prior)
    weights, bias = fit_nnpu(_rows(positive, index), _rows(texts.where(sampled("id", most_unlabelled, n_unlabelled)), index), len(index), prior, seed=seed)
    return Model(prior, index, weights, bias)


def score(df: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the probability that each whole text is toxic, from 0 to 1, in column ``name``.

    Null and empty texts have no features and get the score of the bias alone. A column called ``name`` is
    replaced; all others are kept as they are.
    """
    key, index, weights, bias = uuid.uuid4().hex, model.index, model.weights, model.bias if model.index else float(np.log(model.prior / (1 - model.prior)))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = kept((key,), lambda: Features(index))
        for texts in batches:
            z = np.full(len(texts), bias)
            for at, n in cuts(texts, _SLICE):
                text, feature = _distinct(*features(texts.slice(at, n)), len(index))
                z[at : at + n] += np.bincount(text, weights[feature], n)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        give_back()

    return df.withColumn(name, of(F.col(text_col)))
