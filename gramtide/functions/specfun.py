"""Special functions and tails of count laws in NumPy."""

from __future__ import annotations

import numpy as np

# fixed values: coefficients of the Lanczos approximation (g = 7, n = 9)
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gammaln(x) -> np.ndarray:
    """log Gamma for x > 0."""
    x = np.asarray(x, np.float64)
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    a = np.full_like(y, _LANCZOS[0])
    for i in range(1, 9):
        a = a + _LANCZOS[i] / (y + i)
    t = y + 7.5
    out = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(a)
    with np.errstate(all="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - out, out)


def poisson_logpmf(k, mean):
    k, mean = np.asarray(k, np.float64), np.asarray(mean, np.float64)
    with np.errstate(all="ignore"):
        return np.where(mean > 0, k * np.log(np.maximum(mean, 1e-300)) - mean - gammaln(k + 1), np.where(k == 0, 0.0, -np.inf))


def nb_logpmf(k, mean, r):
    """Negative binomial of a mean and a size r (variance mean + mean^2 / r)."""
    k, mean = np.asarray(k, np.float64), np.asarray(mean, np.float64)
    with np.errstate(all="ignore"):
        log_mean = np.log(np.maximum(mean, 1e-300))
        out = gammaln(k + r) - gammaln(r) - gammaln(k + 1) - r * np.log1p(mean / r) + k * (log_mean - np.log(r + mean))
        return np.where(mean > 0, out, np.where(k == 0, 0.0, -np.inf))


def _beta_fraction(a, b, x) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz); all places go on until the last has settled.

    It takes some roots of the larger of a and b; rounding may keep a place from settling any closer.
    """
    tiny, terms = 1e-300, 200 + int(20 * np.sqrt(max(np.max(a), np.max(b))))
    off = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / off(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, terms):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / off(1 + num * d)
            c = off(1 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-13).all():
            break
    return h


def nb_tail(k, mean, r: float) -> np.ndarray:
    """P(X >= k) of negative binomials for k > 0 and means > 0: a regularised incomplete beta function.

    The work grows with the root of k, that of a sum of terms with k.
    """
    k, mean = (np.atleast_1d(v).astype(np.float64) for v in np.broadcast_arrays(k, mean))
    x, out = mean / (r + mean), np.empty(k.shape)
    front = np.exp(gammaln(k + r) - gammaln(k) - gammaln(r) - k * np.log1p(r / mean) - r * np.log1p(mean / r))
    far = x < (k + 1) / (k + r + 2)
    if far.any():
        out[far] = front[far] * _beta_fraction(k[far], r, x[far]) / k[far]
    if not far.all():
        near = ~far
        out[near] = 1 - front[near] * _beta_fraction(np.full(near.sum(), float(r)), k[near], 1 - x[near]) / r
    return np.clip(out, 0.0, 1.0)


#: Where tails of negative binomials aren't summed term by term: counts under the mean beyond the first, means over so
#: many sizes r (terms over the mean fall slowly then). Cells of terms that are held at once.
FAR, SLOW, CELLS = 1 << 14, 16, 1 << 17


def upper_tail(k, mean, r: float | None = None, terms: int = 100_000) -> np.ndarray:
    """P(X >= k) for each (k, mean), Poisson (r is None) or negative binomial, accurate down to 1e-300.

    Terms are summed upwards from k when k is over the mean, else one minus the terms under k: never one minus a
    sum close to one. Negative binomials take ``nb_tail`` where these sums are long.
    """
    k, mean = np.broadcast_arrays(np.asarray(k, np.float64), np.asarray(mean, np.float64))
    shape, k, mean = k.shape, np.atleast_1d(k), np.atleast_1d(mean)
    out = np.ones(k.shape)
    logp = (lambda x, m: poisson_logpmf(x, m)) if r is None else (lambda x, m: nb_logpmf(x, m, r))
    far = (mean > 0) & (k > 0) & np.where(k > mean, mean > SLOW * r, k > FAR) if r is not None else np.zeros(k.shape, bool)
    if far.any():
        out[far] = nb_tail(k[far], mean[far], r)
    high = (k > mean) & (k > 0) & ~far
    if high.any():
        x, m = k[high].copy(), mean[high]
        term = np.exp(logp(x, m))
        total = term.copy()
        for _ in range(terms):
            term = term * (m / (x + 1) if r is None else (x + r) / (x + 1) * m / (r + m))
            total = total + term
            x += 1
            if (term <= 1e-17 * total).all():
                break
        out[high] = total
    low = np.flatnonzero(~high & (k > 0) & ~far)
    low = low[np.argsort(k[low], kind="stable")]
    x, m, below = k[low], mean[low], np.zeros(len(low))
    end, step = int(x[-1]) if len(low) else 0, max(1, CELLS // max(1, len(low)))
    for first in range(0, end, step):
        at = np.searchsorted(x, first, side="right")  # those that still have a term
        j = np.arange(first, min(first + step, end), dtype=np.float64)[:, None]
        below[at:] += np.where(j < x[at:], np.exp(logp(j, m[at:])), 0).sum(0)
    out[low] = np.maximum(0.0, 1.0 - below)
    return np.minimum(out, 1.0).reshape(shape)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series under a + 1, continued fraction over it."""
    if x <= 0:
        return 1.0
    front = -x + a * np.log(x) - float(gammaln(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(100_000):
            n += 1
            term *= x / n
            total += term
            if term < 1e-16 * total:
                break
        return float(1 - total * np.exp(front))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return float(np.exp(front) * h)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def nb_quantile(q: float, mean: float, r: float) -> int:
    """The least k with P(X <= k) >= q: by its terms, or by halving where these are many or the first of them is 0."""
    if mean > FAR or r * np.log1p(mean / r) > 600:
        low, high = 0, int(2 * mean)  # P(X >= high) comes to 1 - q or less
        while nb_tail(high, mean, r)[0] > 1 - q:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if nb_tail(mid, mean, r)[0] > 1 - q else (low, mid)
        return high - 1
    k, total = 0, float(np.exp(nb_logpmf(0, mean, r)))
    term = total
    while total < q and k < 10_000_000:
        term *= (k + r) / (k + 1) * mean / (r + mean)
        total += term
        k += 1
        if term < 1e-300 and k > mean:
            break
    return k


def _raised(x, ladder):
    """(x + 10, the sum of ``ladder`` over x ... x + 9): the recurrences up to where the asymptotic series hold."""
    x = np.asarray(x, np.float64)
    return x + 10, sum(ladder(x + k) for k in range(10))


def digamma(x) -> np.ndarray:
    """Derivative of log Gamma for x > 0, by recurrence and its asymptotic series (Bernoulli numbers)."""
    y, below = _raised(x, lambda v: 1 / v)
    z = 1 / y**2
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - below


def trigamma(x) -> np.ndarray:
    """Second derivative of log Gamma for x > 0."""
    y, below = _raised(x, lambda v: 1 / v**2)
    z = 1 / y**2
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66)))) + below
