"""Count laws with exposure: a day's law scales with the number of words printed on it.

Each law is a value that knows its tail, its moments, its mass function and its quantiles; ``learn`` finds it from
counts and exposures by maximum likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np

from ..functions import specfun as sf

#: Sizes of a negative binomial: at the largest it is taken as Poisson.
SMALLEST_R, LARGEST_R = 1e-4, 1e6
#: Cells (values x exposures) of a mixture that are held at once.
CELLS = 1 << 21


def _slopes(log_mu: float, log_r: float, x: np.ndarray, n: np.ndarray, of: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of NB(mu n, r) up to a constant, its gradient and Hessian in (log mu, log r)."""
    r = float(np.exp(log_r))
    m = np.exp(log_mu) * n
    both = r + m
    gamma, first, second = (f(counts + r) - f(r) for f in (sf.gammaln, sf.digamma, sf.trigamma))
    value = float((gamma[of] - r * np.log1p(m / r) + x * (np.log(m) - np.log(both))).sum())
    over = (x - m) / both
    g_r = (first[of] - np.log1p(m / r) - over).sum()
    h_r = (second[of] + m / (r * both) + over / both).sum()
    gradient = np.array([r * over.sum(), r * g_r])
    cross = r * (over * m / both).sum()
    return value, gradient, np.array([[-(m * r * (r + x) / both**2).sum(), cross], [cross, r * (r * h_r + g_r)]])


def negative_binomial(x, n, steps: int = 200) -> tuple[float, float]:
    """Rate mu and size r of X ~ NB(mu N, r): Newton's method on (log mu, log r) together.

    The start is by moments. Where the Hessian isn't negative definite, each parameter climbs along its own slope. A
    step is halved until the likelihood rises. Without overdispersion r ends at LARGEST_R.
    """
    x, n = np.asarray(x, float), np.asarray(n, float)
    if len(x) < 2 or x.sum() == 0 or n.sum() == 0:
        raise ValueError("too few counts for a fit")
    counts, of = np.unique(x, return_inverse=True)  # few different counts: their gamma terms are taken once
    low, high = np.log(SMALLEST_R), np.log(LARGEST_R)
    m = x.sum() / n.sum() * n
    excess = ((x - m) ** 2 - m).sum()
    size = np.log((m**2).sum() / excess) if excess > 0 else np.log(1e3)
    at = np.array([np.log(x.sum() / n.sum()), np.clip(size, low, high)])
    value, gradient, hessian = _slopes(*at, x, n, of, counts)
    for _ in range(steps):
        if hessian[0, 0] < 0 and np.linalg.det(hessian) > 0:
            step = -np.linalg.solve(hessian, gradient)
        else:
            step = gradient / np.maximum(np.abs(np.diag(hessian)), 1e-9)
        step = step / max(1.0, np.abs(step).max() / 2)  # shortened as a whole, so that it still climbs
        for _ in range(40):
            new = np.array([at[0] + step[0], np.clip(at[1] + step[1], low, high)])
            found = _slopes(*new, x, n, of, counts)
            if found[0] >= value - 1e-12 * abs(value):
                break
            step = step / 2
        moved = np.abs(new - at).max()
        at, (value, gradient, hessian) = new, found
        if moved < 1e-9:
            break
    return float(np.exp(at[0])), float(np.exp(at[1]))


@dataclass(frozen=True)
class Poisson:
    """X ~ Poisson(lam N)."""

    lam: float
    free: ClassVar[int] = 1

    @classmethod
    def learn(cls, x, n, used) -> Poisson:
        return cls(float(x[used].sum() / n[used].sum()))

    def tail(self, x, n) -> np.ndarray:
        return sf.upper_tail(x, self.lam * n)

    def moments(self, n) -> tuple[np.ndarray, np.ndarray]:
        return self.lam * n, self.lam * n

    def mass(self, k, n) -> np.ndarray:
        return np.exp(sf.poisson_logpmf(k, self.lam * n))


@dataclass(frozen=True)
class NegativeBinomial:
    """X ~ NB(mu N, r): mean mu N, variance mu N + (mu N)^2 / r."""

    mu: float
    r: float
    free: ClassVar[int] = 2

    @classmethod
    def learn(cls, x, n, used) -> NegativeBinomial:
        return cls(*negative_binomial(x[used], n[used]))

    def tail(self, x, n) -> np.ndarray:
        return sf.upper_tail(x, self.mu * n, self.r)

    def moments(self, n) -> tuple[np.ndarray, np.ndarray]:
        mean = self.mu * n
        return mean, mean * (1 + mean / self.r)

    def mass(self, k, n) -> np.ndarray:
        return np.exp(sf.nb_logpmf(k, self.mu * n, self.r))

    def quantile(self, q: float, n: float) -> int:
        """The least k with P(X <= k) >= q."""
        return sf.nb_quantile(q, self.mu * n, self.r)


@dataclass(frozen=True)
class Hurdle:
    """X is 0 with probability p0, whatever the exposure; else X - 1 ~ NB(mu N, r)."""

    p0: float
    mu: float
    r: float
    free: ClassVar[int] = 3

    @property
    def above(self) -> NegativeBinomial:
        return NegativeBinomial(self.mu, self.r)

    @classmethod
    def learn(cls, x, n, used) -> Hurdle:
        """p0 is the share of empty days among all of them, also those that take no part in the fit."""
        active = used & (x > 0)
        return cls(float(np.mean(x == 0)), *negative_binomial(x[active] - 1, n[active]))

    def tail(self, x, n) -> np.ndarray:
        over = (1 - self.p0) * self.above.tail(np.maximum(x - 1, 0), n)
        return np.where(x > 0, over, 1.0)

    def moments(self, n) -> tuple[np.ndarray, np.ndarray]:
        q = 1 - self.p0
        mean, variance = self.above.moments(n)
        # variance of a mixture: within, and between 0 and 1 + mean
        return q * (1 + mean), q * variance + q * self.p0 * (1 + mean) ** 2

    def mass(self, k, n) -> np.ndarray:
        rest = (1 - self.p0) * self.above.mass(np.maximum(k - 1, 0), n)
        return np.where(k > 0, rest, self.p0)

    def quantile(self, q: float, n: float) -> int:
        """0 while the share of empty days covers q; what p0 leaves of q is asked of the law of the other days."""
        if q <= self.p0:
            return 0
        return 1 + self.above.quantile((q - self.p0) / (1 - self.p0), n)


LAWS = {"poisson": Poisson, "nb": NegativeBinomial, "bnb": Hurdle}


@dataclass(frozen=True)
class Fitted:
    """A law with each day's p-value P(X >= x), and the days that its last round took."""

    law: Poisson | NegativeBinomial | Hurdle
    p: np.ndarray
    used: np.ndarray

    def goodness(self, x, n) -> dict[str, float]:
        """Pearson's chi square over the days that were used."""
        mean, variance = self.law.moments(np.asarray(n, float)[self.used])
        chi2 = float(((np.asarray(x, float)[self.used] - mean) ** 2 / np.maximum(variance, 1e-300)).sum())
        dof = float(self.used.sum() - self.law.free)
        if dof <= 0:
            return {"chi2": chi2, "dof": dof, "ratio": float("nan"), "p_gof": float("nan")}
        return {"chi2": chi2, "dof": dof, "ratio": chi2 / dof, "p_gof": sf.chi2_sf(chi2, dof)}


def rounds(x, n, law: str, obvious: float, held: dict | None = None):
    """Endless rounds of a fit: after each one the days under ``obvious`` leave. Days without exposure never take part.

    A round on the days of one before has its fit. ``held`` keeps fits by their days: rounds of one series and law share it.
    """
    x, n = np.asarray(x, float), np.asarray(n, float)
    used, held = n > 0, {} if held is None else held
    while True:
        key = used.tobytes()
        if key not in held:
            found = LAWS[law].learn(x, n, used)
            held[key] = Fitted(found, found.tail(x, n), used)
        yield held[key]
        p = held[key].p
        used = used & ~(p < obvious)


def mixture(law, x, n, most: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the days' mass functions over the ``most`` last values up to a third over the largest count."""
    exposures, times = np.unique(np.asarray(n, float), return_counts=True)
    end = int(np.max(x) * 1.3) + 6
    k = np.arange(max(0, end - most), end)
    mean, width = np.zeros(len(k)), max(1, CELLS // len(k))
    for part in range(0, len(exposures), width):
        mean += law.mass(k[:, None], exposures[None, part : part + width]) @ times[part : part + width]
    return k, mean / times.sum()
