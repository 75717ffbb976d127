"""Shares that vary more than chance lets them: the beta-binomial law, and the test of a break in it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import specfun as sf

#: Weights M = a + b between which the law is sought; rho = 1 / (M + 1). At the upper end it is the binomial law.
WEIGHTS = (1e-2, 1e7)
_GOLDEN = (5**0.5 - 1) / 2


def log_likelihood(x: np.ndarray, n: np.ndarray, c: np.ndarray, mu: float, weight: float) -> float:
    """Of days with x of n, each c times, up to what no parameter changes."""
    a, b = mu * weight, (1 - mu) * weight
    rise = lambda k, s: sf.gammaln(k + s) - sf.gammaln(s)
    return float((c * (rise(x, a) + rise(n - x, b) - rise(n, weight))).sum())


def best_share(x: np.ndarray, n: np.ndarray, c: np.ndarray, weight: float) -> float:
    """The share of greatest likelihood under a weight: Newton's steps on its logit, halved where they overshoot."""
    total, of = float((c * x).sum()), float((c * n).sum())
    if total <= 0 or total >= of:
        return 1e-12 if total <= 0 else 1 - 1e-12
    at = np.log(total / (of - total))
    now, low, high = None, -30.0, 30.0
    for _ in range(60):
        mu = 1 / (1 + np.exp(-at))
        a, b = mu * weight, (1 - mu) * weight
        slope = weight * float((c * (sf.digamma(x + a) - sf.digamma(a) - sf.digamma(n - x + b) + sf.digamma(b))).sum())
        bend = weight**2 * float((c * (sf.trigamma(x + a) - sf.trigamma(a) + sf.trigamma(n - x + b) - sf.trigamma(b))).sum())
        low, high = (at, high) if slope > 0 else (low, at)
        by = mu * (1 - mu)
        curve = bend * by * by + slope * by * (1 - 2 * mu)
        step = -slope * by / curve if curve < 0 else np.nan
        now = at + step if low < at + step < high else (low + high) / 2
        if abs(now - at) < 1e-9:
            break
        at = now
    return float(1 / (1 + np.exp(-now)))


def fit(x: np.ndarray, n: np.ndarray, part: np.ndarray) -> tuple[list[float], float, float]:
    """(shares by part, weight, log likelihood): a share for each number in ``part``, one weight for all.

    Days are counted by (x, n); the weight is sought by golden sections, the shares follow from it.
    """
    groups = []
    for k in np.unique(part):
        seen, c = np.unique(np.stack([x[part == k], n[part == k]]), axis=1, return_counts=True)
        groups.append((seen[0].astype(float), seen[1].astype(float), c.astype(float)))

    def at(log_weight: float) -> tuple[float, list[float]]:
        w = float(np.exp(log_weight))
        mus = [best_share(*g, w) for g in groups]
        return sum(log_likelihood(*g, mu, w) for g, mu in zip(groups, mus, strict=True)), mus

    # the likelihood has one top, but may be flat far off: a coarse walk finds where to look closely
    grid = np.linspace(*np.log(WEIGHTS), 13)
    top = int(np.argmax([at(g)[0] for g in grid]))
    low, high = grid[max(0, top - 1)], grid[min(len(grid) - 1, top + 1)]
    one, two = high - _GOLDEN * (high - low), low + _GOLDEN * (high - low)
    f1, f2 = at(one)[0], at(two)[0]
    while high - low > 1e-4:
        if f1 >= f2:
            high, two, f2 = two, one, f1
            one = high - _GOLDEN * (high - low)
            f1 = at(one)[0]
        else:
            low, one, f1 = one, two, f2
            two = low + _GOLDEN * (high - low)
            f2 = at(two)[0]
    best = (low + high) / 2
    value, mus = at(best)
    return mus, float(np.exp(best)), value


def break_test(x: np.ndarray, n: np.ndarray, late: np.ndarray) -> tuple[float, float, float, float, float]:
    """(share before, share after, rho, likelihood ratio, p) of a break at a known date; rho is common to both parts."""
    there = n > 0
    x, n, late = x[there], n[there], late[there]
    if not late.any() or late.all():
        return np.nan, np.nan, np.nan, 0.0, 1.0
    _, _, one = fit(x, n, np.zeros(len(x), int))
    (before, after), weight, two = fit(x, n, late.astype(int))
    ratio = max(0.0, 2 * (two - one))
    return before, after, 1 / (weight + 1), ratio, sf.chi2_sf(ratio, 1)


def breaks_at(series: DataFrame, date) -> DataFrame:
    """series(mot, date, x, n_tot) -> (mot, before, after, rho, lrt, p): each word's share before and from a date on.

    Days without exposure say nothing; a word all of whose days lie on one side has a ratio of 0 and no shares.
    """

    def one(key, df: pd.DataFrame) -> pd.DataFrame:
        late = pd.to_datetime(df["date"]).to_numpy() >= np.datetime64(date)
        found = break_test(df["x"].to_numpy(), df["n_tot"].to_numpy(), late)
        return pd.DataFrame([(key[0], *found)], columns=["mot", "before", "after", "rho", "lrt", "p"])

    return series.groupBy("mot").applyInPandas(one, "mot string, before double, after double, rho double, lrt double, p double")
