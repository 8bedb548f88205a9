"""The counts that features are chosen by."""

import numpy as np
import pytest

pytest.importorskip("panelkit.llm")
from panelkit.llm import toxicity  # noqa: E402


def test_all_candidates_are_counted_in_all_documents(spark, monkeypatch):
    """Nothing is chosen by counts in a part of the documents, or of the candidates."""
    real, seen = toxicity._document_frequencies, []

    def counted(texts, index):
        seen.append((texts.count(), set(index)))
        return real(texts, index)

    monkeypatch.setattr(toxicity, "_document_frequencies", counted)
    rows = [(i, "the vile one" if i % 8 == 0 else "the other one") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    # Also "the", which every document has.
    assert seen == [(9000, toxicity.grams("the") | toxicity.grams("vile") | toxicity.grams("one"))]
    assert "<vile>" in model.index and "<the>" not in model.index


def _plain_fit(positive, unlabelled, n, prior, epochs, rate, decay):
    """The same estimator on dense rows, its slopes by differences of the risk itself; also how often it stepped back."""
    p, u = (np.array([[i in r for i in range(n)] + [1] for r in rows], float) for rows in (positive, unlabelled))
    soft = lambda x: np.logaddexp(0, x)

    def negative(w):
        return soft(u @ w).mean() - prior * soft(p @ w).mean()

    def whole(w):
        return prior * soft(-(p @ w)).mean() + negative(w)

    def slope(f, w, h=1e-6):
        return np.array([(f(w + h * e) - f(w - h * e)) / (2 * h) for e in np.eye(n + 1)])

    w = np.append(np.zeros(n), np.log(prior / (1 - prior)))
    m, v, back = np.zeros(n + 1), np.zeros(n + 1), 0
    for step in range(1, epochs + 1):
        if negative(w) >= 0:
            g = slope(whole, w)
        else:
            g, back = -slope(negative, w), back + 1
        g = g + decay * np.append(w[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, back


@pytest.mark.parametrize(
    ("positive", "unlabelled", "prior"),
    [
        ([[0], [0, 1], [0]], [[0, 1], [1], [2], [1, 2], []], 0.2),
        ([[0]] * 4, [[1]] * 40, 0.9),
    ],
)
def test_the_fit_equals_a_plain_one(positive, unlabelled, prior):
    """The non-negative risk, its slopes, and the step back where its negative part is below zero."""
    want, back = _plain_fit(positive, unlabelled, 3, prior, 120, 0.05, 1e-4)
    w, b = toxicity.fit_nnpu(positive, unlabelled, 3, prior, epochs=120, rate=0.05)
    assert np.append(w, b) == pytest.approx(want, abs=2e-3)
    assert 0 < back < 120


def test_a_score_by_hand(spark):
    model = toxicity.Model(0.1, {"<vile>": 0, "<one>": 1}, np.array([2.0, -0.5]), -1.5)
    rows = [(1, "the vile vile ONE"), (2, "one"), (3, ""), (4, None), (5, "nothing here")]
    got = {r["i"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "i int, text string"), model).collect()}
    for i, z in ((1, -1.5 + 2.0 - 0.5), (2, -2.0), (3, -1.5), (4, -1.5), (5, -1.5)):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))
