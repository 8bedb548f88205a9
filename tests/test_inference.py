"""Cluster inference against explicit matrices, and the inverted bootstrap test against bisection."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import stats

GROUPS = (3, 4, 6, 8, 9, 11, 14)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for g, n in enumerate(GROUPS):
        shift = rng.normal()
        for _ in range(n):
            base = rng.normal()
            for t in range(5):
                if rng.random() < 0.85:
                    x, z = rng.normal() + 0.5 * shift * t, rng.normal()
                    rows.append((f"f{i:03}", 2000 + t, f"g{g}", 0.3 * x - 0.2 * z + base + 0.1 * t + shift * rng.normal(), x, z))
            i += 1
    return spark.createDataFrame(rows, "firm string, year int, grp string, y double, x double, z double")


@pytest.fixture(scope="module")
def gram(panel):
    return stats.gram(panel, "y", ["x", "z"], "firm", "year", "grp")


def power(m, p):
    values, vectors = np.linalg.eigh(m)
    good = values > 1e-9
    return (vectors[:, good] * values[good] ** p) @ vectors[:, good].T


def test_hc2_and_its_degrees_of_freedom_on_seven_clusters(panel, gram):
    p = panel.toPandas()
    x = np.column_stack([p[["x", "z"]], pd.get_dummies(p["firm"]).to_numpy(float), pd.get_dummies(p["year"]).to_numpy(float)[:, 1:]])
    m = np.linalg.pinv(x.T @ x)
    resid = np.eye(len(p)) - x @ m @ x.T
    u = resid @ p["y"].to_numpy()
    total, g = 0.0, []
    for c in sorted(p["grp"].unique()):
        at = (p["grp"] == c).to_numpy()
        a = power(resid[np.ix_(at, at)], -0.5)
        total += float(m[0] @ x[at].T @ a @ u[at]) ** 2
        g.append(resid[:, at] @ a @ x[at] @ m[:, 0])
    cross = np.array(g) @ np.array(g).T
    f = stats.fit_hc2(gram)
    assert f.clusters == len(GROUPS)
    assert f.beta == pytest.approx((m @ x.T @ p["y"].to_numpy())[0])
    assert f.se == pytest.approx(math.sqrt(total), rel=1e-8)
    assert f.dof == pytest.approx(np.trace(cross) ** 2 / (cross**2).sum(), rel=1e-7) and 1 < f.dof < len(GROUPS) - 1
    assert f.p == pytest.approx(stats.t_p_value(f.beta / f.se, f.dof)) and stats.t_p_value((f.high - f.beta) / f.se, f.dof) == pytest.approx(0.05)


@pytest.mark.parametrize("webb", [True, False])
def test_interval_equals_bisection(spark, gram, webb):
    reps = 399
    w = stats.cluster_weights(np.arange(reps), len(gram.clusters), 0, webb)

    def p(value):
        t, s = stats._bootstrap_t(gram, value, w)
        return min(1.0, 2 * min((s <= t + 1e-9).mean(), (s >= t - 1e-9).mean()))

    found = stats.bootstrap_p_function(spark, gram, reps, webb=webb)
    beta, se = stats.fit(gram).beta, stats.fit(gram).se
    for value in beta + se * np.linspace(-6, 6, 41):
        assert found(value) == pytest.approx(p(value), abs=1e-12)
    low, high = stats.bootstrap_interval(spark, gram, reps, level=0.8, webb=webb)
    for end, sign in ((low, -1), (high, 1)):
        inside, outside = beta, beta + sign * 2 * abs(end - beta)
        assert p(outside) <= 0.2
        for _ in range(60):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if p(mid) > 0.2 else (inside, mid)
        assert end == pytest.approx(inside, abs=1e-9)


def test_interval_is_one_job(spark, gram):
    spark.sparkContext.setJobGroup("interval", "interval")
    try:
        stats.bootstrap_interval(spark, gram, 99)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("interval")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lagged_specification(panel):
    lagged = stats.lagged_regressors(panel, "firm", "year", ["x"])
    p = panel.toPandas().set_index(["firm", "year"])
    for r in lagged.collect():
        want = p["x"].get((r["firm"], r["year"] - 1))
        assert r["x_lag"] == want if want is not None else r["x_lag"] is None
    specs = [{"model": "lagged", "outcome": "y", "policy": "x_lag"}, {"model": "same", "outcome": "y", "policy": "x", "where": F.col("x_lag").isNotNull()}]
    got = {r["model"]: r for r in stats.models(lagged, specs, "firm", "year", "grp").collect()}
    n = sum((f, y - 1) in p.index for f, y in p.index)
    assert got["lagged"]["n"] == got["same"]["n"] == n and got["lagged"]["beta"] != got["same"]["beta"]
