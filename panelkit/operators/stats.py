"""Fixed-effects regression with cluster-robust and wild-bootstrap inference from one-pass aggregates.

A model needs the cross products of its demeaned columns by cluster: a k * k matrix for each of few clusters.
Spark sums them in one aggregation; numpy solves what is left, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.contracts import ContractError

#: Equal weights for all clusters give the data's own t again, but for rounding.
_TIE = 1e-9

#: The six points of Webb's distribution. Fixed values.
WEBB = (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))


def demeaned(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """``df`` with columns minus their entity's mean."""
    w = Window.partitionBy(entity)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def assert_nested(df: DataFrame, entity: str, cluster: str) -> DataFrame:
    """``df``, if each entity lies in one cluster."""
    bad = df.groupBy(entity).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b")).where("a <> b").limit(1).count()
    if bad:
        raise ContractError(f"{cluster} varies within {entity}")
    return df


@dataclass
class Gram:
    """Cross products by cluster: xx[g] is k * k, xy[g] has k entries, yy[g] is a number."""

    names: list[str]
    clusters: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: int
    entities: int
    years: int = 0


def gram(df: DataFrame, outcome: str, regressors: list[str], entity: str, year: str, cluster: str) -> Gram:
    """Complete cases, year indicators made explicit, all demeaned by entity, and summed by cluster.

    The first year's indicator is left out. What reaches the driver is one row of k * k numbers a cluster.
    """
    used = [outcome, *regressors, entity, year, cluster]
    full = df.select(*used).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in used]))
    years = sorted(r[0] for r in full.select(year).distinct().collect())
    dummies = [f"__y{v}" for v in years[1:]]
    rows = full.withColumns({f"__y{v}": (F.col(year) == v).cast("double") for v in years[1:]})
    names = [*regressors, *dummies]
    rows = demeaned(rows.withColumns({c: F.col(c).cast("double") for c in (outcome, *regressors)}), entity, [outcome, *names])
    cells = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col(outcome)) for a in names] + [F.sum(F.col(outcome) * F.col(outcome)), F.count("*").cast("double"), F.count_distinct(entity).cast("double")]
    found = rows.groupBy(F.col(cluster).cast("string").alias("__c")).agg(F.array(*cells).alias("x")).orderBy("__c").collect()
    k = len(names)
    v = np.array([r["x"] for r in found], float).reshape(len(found), -1)
    xx, upper = np.zeros((len(v), k, k)), np.triu_indices(k)
    xx[:, upper[0], upper[1]] = v[:, : len(upper[0])]
    xx[:, upper[1], upper[0]] = v[:, : len(upper[0])]
    at = len(upper[0])
    return Gram(names, [r["__c"] for r in found], xx, v[:, at : at + k], v[:, at + k], int(v[:, at + k + 1].sum()), int(v[:, at + k + 2].sum()), len(years))


@dataclass
class Fit:
    beta: float
    se: float
    p: float
    low: float
    high: float
    n: int
    entities: int
    clusters: int
    within_r2: float
    betas: dict[str, float] = field(default_factory=dict)
    dof: float = math.nan


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_p_value(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return _incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def t_quantile(p: float, dof: float) -> float:
    """The value that Student's t exceeds in absolute size with probability ``p``, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_p_value(mid, dof) > p else (lo, mid)
    return (lo + hi) / 2


def normal_p_value(beta: float, se: float) -> float:
    return math.erfc(abs(beta / se) / math.sqrt(2))


def fit(g: Gram, count_dummies: bool = True) -> Fit:
    """OLS of the first regressor with cluster-robust errors, small-sample factor G/(G-1) * (n-1)/(n-k).

    ``count_dummies`` decides whether k has the entity effects, the convention of explicit dummies, or only
    the other regressors and a constant.
    """
    xx, xy = g.xx.sum(0), g.xy.sum(0)
    inv = np.linalg.pinv(xx)
    b = inv @ xy
    scores = g.xy - g.xx @ b
    n_g = len(g.clusters)
    k = len(g.names) + (g.entities if count_dummies else 1)
    factor = n_g / (n_g - 1) * (g.n - 1) / (g.n - k) if n_g > 1 and g.n > k else math.nan
    v = factor * inv @ (scores.T @ scores) @ inv
    se = math.sqrt(max(v[0, 0], 0)) if v[0, 0] == v[0, 0] else math.nan
    dof = n_g - 1
    p = t_p_value(b[0] / se, dof) if se > 0 else math.nan
    half = t_quantile(0.05, dof) * se if se > 0 else math.nan
    # Within R squared is of the regressors beyond the year effects.
    years = [i for i, x in enumerate(g.names) if x.startswith("__y")]
    base = g.yy.sum() - (xy[years] @ np.linalg.pinv(xx[np.ix_(years, years)]) @ xy[years] if years else 0.0)
    rss = g.yy.sum() - xy @ b
    return Fit(float(b[0]), se, p, float(b[0]) - half, float(b[0]) + half, g.n, g.entities, n_g, float(1 - rss / base) if base else math.nan, dict(zip(g.names, b.tolist(), strict=True)), float(dof))


def dropped(g: Gram, cluster: str) -> Gram:
    """The cross products without a cluster: exact, as entities nest in clusters and year indicators are columns."""
    keep = [i for i, c in enumerate(g.clusters) if c != cluster]
    return Gram(g.names, [g.clusters[i] for i in keep], g.xx[keep], g.xy[keep], g.yy[keep], g.n, g.entities, g.years)


def leave_one_out(g: Gram) -> dict[str, float]:
    """The first coefficient without each cluster in turn."""
    return {c: float((np.linalg.pinv(d.xx.sum(0)) @ d.xy.sum(0))[0]) for c in g.clusters for d in [dropped(g, c)]}


def _restricted(g: Gram, value: float) -> np.ndarray:
    """Coefficients with the first one held at ``value``."""
    xx, xy = g.xx.sum(0), g.xy.sum(0)
    rest = np.linalg.pinv(xx[1:, 1:]) @ (xy[1:] - xx[1:, 0] * value) if len(g.names) > 1 else np.zeros(0)
    return np.append(value, rest)


def _bootstrap_t(g: Gram, value: float, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """t of the first coefficient against ``value``, and its bootstrap values under that null, a row of weights each."""
    xx = g.xx.sum(0)
    inv = np.linalg.pinv(xx)

    def t_of(b: np.ndarray, scores: np.ndarray) -> float:
        v = (inv @ (scores.T @ scores) @ inv)[0, 0]
        return (b[0] - value) / math.sqrt(v) if v > 0 else 0.0

    b = inv @ g.xy.sum(0)
    r = _restricted(g, value)
    u = g.xy - g.xx @ r  # scores of the restricted residuals
    out = np.empty(len(weights))
    for i, w in enumerate(weights):
        star = w[:, None] * u
        d = inv @ star.sum(0)
        out[i] = t_of(r + d, star - g.xx @ d)
    return t_of(b, g.xy - g.xx @ b), out


def cluster_weights(reps: np.ndarray, clusters: int, seed: int, webb: bool = True) -> np.ndarray:
    """Weights of each repetition and cluster, the same wherever they are drawn."""
    points = np.array(WEBB if webb else (-1.0, 1.0))
    return np.array([points[np.random.default_rng([seed, int(r)]).integers(0, len(points), clusters)] for r in reps])


def wild_bootstrap(spark: SparkSession, g: Gram, value: float = 0.0, reps: int = 10_000, seed: int = 0, webb: bool = True) -> tuple[float, float]:
    """(t, equal-tailed p) of the wild cluster bootstrap-t with the null imposed; repetitions run as Spark tasks.

    A task gets the cross products alone, which are as small for any number of rows.
    """
    t, _ = _bootstrap_t(g, value, np.zeros((0, len(g.clusters))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, s = _bootstrap_t(g, value, cluster_weights(b["id"].to_numpy(), len(g.clusters), seed, webb))
            yield pd.DataFrame({"below": [int((s <= t + _TIE).sum())], "above": [int((s >= t - _TIE).sum())], "n": [len(s)]})

    r = spark.range(reps).mapInPandas(run, "below long, above long, n long").agg(F.sum("below"), F.sum("above"), F.sum("n")).first()
    return t, min(1.0, 2 * min(r[0], r[1]) / r[2])


@dataclass
class PFunction:
    """The bootstrap's p-value as a function of the tested value: steps between the places where some repetition's t crosses the data's."""

    breaks: np.ndarray
    below: np.ndarray
    above: np.ndarray
    reps: int

    def __call__(self, value: float) -> float:
        i = int(np.searchsorted(self.breaks, value, "right"))
        return min(1.0, 2 * min(int(self.below[i]), int(self.above[i])) / self.reps)

    def interval(self, estimate: float, level: float = 0.95) -> tuple[float, float]:
        """The values around ``estimate`` that are not rejected: to the first step on each side where they are; infinite without one."""
        rejected = 2 * np.minimum(self.below, self.above) / self.reps <= 1 - level
        at = int(np.searchsorted(self.breaks, estimate, "right"))
        left = np.flatnonzero(rejected[: at + 1])
        right = np.flatnonzero(rejected[at:])
        low = float(self.breaks[left[-1]]) if len(left) and left[-1] < at else -math.inf
        high = float(self.breaks[at + right[0] - 1]) if len(right) and right[0] > 0 else math.inf
        return (math.nan, math.nan) if rejected[at] else (low, high)


def _t_lines(g: Gram, weights: np.ndarray) -> np.ndarray:
    """(a, b, q0, q1, q2) of each repetition: its t against a tested value v is (a + b v) / sqrt(q0 + q1 v + q2 v^2).

    The restricted scores are linear in the tested value, so the repetition's coefficient and its clusters' scores are too.
    """
    inv = np.linalg.pinv(g.xx.sum(0))
    at_zero = g.xy - g.xx @ _restricted(g, 0.0)
    slope = g.xy - g.xx @ _restricted(g, 1.0) - at_zero
    hat = np.einsum("j,gjk->gk", inv[0], g.xx)

    def moved(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first coefficient's move, and each cluster's score in its direction, by repetition."""
        d = (weights @ u) @ inv
        return d[:, 0], weights * (u @ inv[0]) - d @ hat.T

    (a, e), (b, f) = moved(at_zero), moved(slope)
    return np.stack([a, b, (e * e).sum(1), 2 * (e * f).sum(1), (f * f).sum(1)], 1)


def _crossings(lines: np.ndarray, estimate: float, se: float) -> PFunction:
    """Where each repetition's t crosses (estimate - v) / se: real roots of a polynomial of degree four, and the signs between them."""
    a, b, q0, q1, q2 = lines.T
    t = estimate
    # (a + b v)^2 se^2 = (t - v)^2 (q0 + q1 v + q2 v^2), from v^4 down.
    c = np.stack([-q2, 2 * t * q2 - q1, b * b * se**2 - q0 + 2 * t * q1 - t * t * q2, 2 * a * b * se**2 + 2 * t * q0 - t * t * q1, a * a * se**2 - t * t * q0], 1)
    breaks: list[float] = []
    steps: list[tuple[int, int]] = []
    start = np.zeros(2, np.int64)

    def signs(line: np.ndarray, v: float) -> tuple[int, int]:
        q = line[2] + line[3] * v + line[4] * v * v
        star = (line[0] + line[1] * v) / math.sqrt(q) if q > 0 else 0.0
        own = (t - v) / se
        return int(star <= own), int(star >= own)

    size = np.abs(np.stack([q2, b * b * se**2, a * a * se**2, q0, t * q1, t * t * q2])).max(0)
    for line, poly, most in zip(lines, c, size, strict=True):
        if (np.abs(poly) <= _TIE * most).all():
            # The data's own t for every value, or the same with the other sign.
            spots = [signs(line, t - se), signs(line, t + se)]
            if line[0] + line[1] * (t - se) > 0:
                start += 1
            else:
                start += spots[0]
                breaks.append(t)
                steps.append((spots[1][0] - spots[0][0], spots[1][1] - spots[0][1]))
            continue
        roots = np.roots(poly)
        real = np.sort(roots[np.abs(roots.imag) <= 1e-9 * (1 + np.abs(roots.real))].real)
        spots = [real[0] - 1 - abs(real[0]), *((real[1:] + real[:-1]) / 2), real[-1] + 1 + abs(real[-1])] if len(real) else [t]
        found = [signs(line, v) for v in spots]
        start += found[0]
        for v, x, y in zip(real, found[:-1], found[1:], strict=True):
            if x != y:
                breaks.append(v)
                steps.append((y[0] - x[0], y[1] - x[1]))
    order = np.argsort(breaks)
    moves = np.concatenate([start[None], np.array(steps, np.int64).reshape(-1, 2)[order]])
    below, above = np.cumsum(moves, 0).T
    return PFunction(np.array(breaks)[order], below, above, len(lines))


def bootstrap_p_function(spark: SparkSession, g: Gram, reps: int = 999, seed: int = 0, webb: bool = True) -> PFunction:
    """The wild cluster bootstrap's p-value for every tested value, from one job.

    A repetition is five numbers whatever value is tested: what reaches the driver is bounded by ``reps``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(_t_lines(g, cluster_weights(b["id"].to_numpy(), len(g.clusters), seed, webb)), columns=list("abcde"))

    found = spark.range(reps).mapInPandas(run, "a double, b double, c double, d double, e double").collect()
    inv = np.linalg.pinv(g.xx.sum(0))
    coef = inv @ g.xy.sum(0)
    scores = (g.xy - g.xx @ coef) @ inv[0]
    return _crossings(np.array([tuple(r) for r in found]), float(coef[0]), float(np.sqrt(scores @ scores)))


def bootstrap_interval(spark: SparkSession, g: Gram, reps: int = 999, seed: int = 0, level: float = 0.95, webb: bool = True) -> tuple[float, float]:
    """The values whose null isn't rejected, around the estimate: the inverted bootstrap test, in one job."""
    return bootstrap_p_function(spark, g, reps, seed, webb).interval(fit(g).beta, level)


def _root(symmetric: np.ndarray, power: float) -> np.ndarray:
    """A power of a positive semidefinite matrix, by its eigenvalues; what is zero stays zero."""
    values, vectors = np.linalg.eigh(symmetric)
    good = values > 1e-10 * max(values.max(initial=0), 1e-300)
    return (vectors[:, good] * values[good] ** power) @ vectors[:, good].T


def fit_hc2(g: Gram, level: float = 0.95) -> Fit:
    """``fit`` with cluster HC2 errors and Satterthwaite's degrees of freedom, after Bell and McCaffrey.

    Each cluster's residuals are divided by the root of I - H of its own rows. With M the inverse of all cross products and
    S those of a cluster, X' (I - X M X')^(-1/2) is (I - S M)^(-1/2) X', so a k * k matrix a cluster is enough, and rows are
    not needed; entity effects lie inside clusters and in none of the demeaned columns, so they change nothing. A direction
    that one cluster alone determines has no residual and is left out of the root. The degrees of freedom are those of the
    chi-square whose mean and variance the error's square has under equal independent errors.
    """
    base = fit(g)
    m = np.linalg.pinv(g.xx.sum(0))
    half, back = _root(m, 0.5), _root(m, -0.5)
    b = m @ g.xy.sum(0)
    scores, p, own = [], [], []
    for s, u in zip(g.xx, g.xy - g.xx @ b, strict=True):
        inner = np.eye(len(m)) - half @ s @ half
        scores.append(m[0] @ (back @ _root(inner, -0.5) @ half) @ u)
        p.append(back @ _root(inner, -0.5) @ half @ s @ m[:, 0])
        own.append(m[0] @ (back @ _root(inner, -1.0) @ half) @ s @ m[:, 0])
    se = math.sqrt(float(np.sum(np.square(scores))))
    cross = np.diag(own) - np.array(p) @ m @ np.array(p).T
    dof = float(np.trace(cross) ** 2 / np.sum(cross * cross))
    pv = t_p_value(b[0] / se, dof) if se > 0 else math.nan
    width = t_quantile(1 - level, dof) * se if se > 0 else math.nan
    return replace(base, beta=float(b[0]), se=se, p=pv, low=float(b[0]) - width, high=float(b[0]) + width, dof=dof)


def lagged_regressors(df: DataFrame, entity: str, period: str, columns: list[str], suffix: str = "_lag") -> DataFrame:
    """``df`` with ``columns`` of the entity's one row of the period before: null in a first period and after a gap."""
    from panelkit.operators.panel import previous

    return previous(df, entity, period, columns, suffix)


def models(df: DataFrame, specs: list[dict], entity: str, year: str, cluster: str) -> DataFrame:
    """(model, beta, se, p, low, high, n, entities, clusters, within_r2) for specs of model, outcome, policy and controls.

    A spec's ``where`` restricts its sample.
    """
    rows = []
    for s in specs:
        part = df.where(s["where"]) if s.get("where") is not None else df
        f = fit(gram(part, s["outcome"], [s["policy"], *s.get("controls", [])], entity, year, cluster))
        rows.append((s["model"], *map(float, (f.beta, f.se, f.p, f.low, f.high)), f.n, f.entities, f.clusters, float(f.within_r2)))
    return df.sparkSession.createDataFrame(rows, "model string, beta double, se double, p double, low double, high double, n long, entities long, clusters long, within_r2 double")


def estimates_agree(a: DataFrame, b: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """(model, difference, agree) over two engines' (model, beta, n); both must have the same models."""
    j = a.select("model", F.col("beta").alias("x"), F.col("n").alias("m")).join(b.select("model", F.col("beta").alias("y"), F.col("n").alias("k")), "model", "full")
    d = F.abs(F.col("x") - F.col("y"))
    return j.select("model", d.alias("difference"), F.coalesce((d <= tolerance) & (F.col("m") == F.col("k")), F.lit(False)).alias("agree"))


def coherent(low: float, high: float, p: float, level: float = 0.95) -> bool:
    """Whether an interval leaves out zero exactly where the p-value rejects it."""
    return (low > 0 or high < 0) == (p < 1 - level)
