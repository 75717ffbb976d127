"""The fits of count laws as SQL, for the oracles: Newton's steps on (log mu, log r) as a recursive query.

Sums over the terms under a count take the place of digamma functions: counts are whole numbers. There is no line
search; steps are at most one long, which is enough for series of words.
"""

from __future__ import annotations

from ..operators.laws import LARGEST_R, SMALLEST_R

STEPS = 80


def _clip(value: str, low: str, high: str) -> str:
    return f"least(greatest({value}, {low}), {high})"


def fitted(name: str, source: str) -> str:
    """CTEs that end in ``name`` (mot, mu, r); source(mot, x, n): the days of each fit. Needs WITH RECURSIVE."""
    low, high = f"ln({SMALLEST_R}::DOUBLE)", f"ln({LARGEST_R}::DOUBLE)"
    under = "list_sum(list_transform(range(0, x::BIGINT), lambda j: 1.0 / (exp(t) + j)))"
    under2 = "list_sum(list_transform(range(0, x::BIGINT), lambda j: 1.0 / ((exp(t) + j) * (exp(t) + j))))"
    return f"""
    {name}_d AS (SELECT mot, x::DOUBLE AS x, n::DOUBLE AS n FROM ({source})),
    {name}_s AS (SELECT mot, sum(x) / sum(n) AS mu0 FROM {name}_d GROUP BY mot HAVING count(*) >= 2 AND sum(x) > 0 AND sum(n) > 0),
    {name}_i AS (
        SELECT mot, 0 AS i, ln(mu0) AS a, {_clip("CASE WHEN e > 0 THEN ln(q / e) ELSE ln(1000) END", low, high)} AS t
        FROM (SELECT mot, any_value(mu0) AS mu0, sum((x - mu0 * n) ** 2 - mu0 * n) AS e, sum((mu0 * n) ** 2) AS q FROM {name}_d JOIN {name}_s USING (mot) GROUP BY mot)
        UNION ALL
        SELECT mot, i + 1, a + da / greatest(1, abs(da), abs(dt)), {_clip("t + dt / greatest(1, abs(da), abs(dt))", low, high)}
        FROM (SELECT mot, i, a, t,
                     CASE WHEN haa < 0 AND haa * htt > hat * hat THEN (hat * gt - htt * ga) / (haa * htt - hat * hat) ELSE ga / greatest(abs(haa), 1e-9) END AS da,
                     CASE WHEN haa < 0 AND haa * htt > hat * hat THEN (hat * ga - haa * gt) / (haa * htt - hat * hat) ELSE gt / greatest(abs(htt), 1e-9) END AS dt
              FROM (SELECT mot, i, a, t, r * so AS ga, r * gr AS gt, -ha AS haa, r * so2 AS hat, r * (r * hr + gr) AS htt
                    FROM (SELECT mot, i, a, t, r, sum(o) AS so, sum(u - ln(1 + m / r) - o) AS gr, sum(m * r * (r + x) / (b * b)) AS ha, sum(o * m / b) AS so2, sum(m / (r * b) + o / b - u2) AS hr
                          FROM (SELECT mot, i, a, t, x, exp(t) AS r, exp(a) * n AS m, exp(t) + exp(a) * n AS b, (x - exp(a) * n) / (exp(t) + exp(a) * n) AS o, coalesce({under}, 0) AS u, coalesce({under2}, 0) AS u2
                                FROM {name}_i JOIN {name}_d USING (mot) WHERE i < {STEPS})
                          GROUP BY mot, i, a, t, r))))
    , {name} AS (SELECT mot, exp(a) AS mu, exp(t) AS r FROM {name}_i WHERE i = {STEPS})"""


def nb_mass(k: str, m: str, r: str) -> str:
    """Mass of NB(mean m, size r) at k."""
    return f"exp(lgamma({k} + {r}) - lgamma({r}) - lgamma({k} + 1) - {r} * ln(1 + {m} / {r}) + ({k}) * ln({m} / ({r} + {m})))"


def nb_tail(x: str, m: str, r: str) -> str:
    """P(X >= x), as one less the terms under x."""
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, ({x})::BIGINT), lambda k: {nb_mass('k', m, r)}))) END"


def chi2_upper(chi2: str, dof: str) -> str:
    """P(chi square of ``dof`` >= chi2), by the series of the lower incomplete gamma function."""
    a, x = f"({dof} / 2.0)", f"({chi2} / 2.0)"
    terms = f"list_sum(list_transform(range(0, 600 + (2 * {x})::BIGINT), lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1))))"
    return f"CASE WHEN {x} > 0 THEN greatest(0.0, 1 - {terms}) ELSE 1.0 END"


#: What a word's days are called in the queries below: w(mot, date, x, n_tot).
_USED = "n_tot > 0"


def poisson(name: str) -> str:
    """CTE ``name``: w with used, p0, mean and variance of each day under a Poisson law."""
    return f"{name} AS (SELECT w.*, {_USED} AS used, lam * n_tot AS e, lam * n_tot AS v FROM w JOIN (SELECT mot, sum(x)::DOUBLE / sum(n_tot) AS lam FROM w WHERE {_USED} GROUP BY mot) USING (mot))"


def nb(name: str) -> str:
    """CTEs that end in ``name``: w with mu, r, used, p, mean and variance of each day under a negative binomial law."""
    days = f"SELECT mot, x, n_tot AS n FROM w WHERE {_USED}"
    return f"{fitted(name + '_f', days)}, {name} AS (SELECT w.*, mu, r, NULL::DOUBLE AS p0, {_USED} AS used, {nb_tail('x', '(mu * n_tot)', 'r')} AS p, mu * n_tot AS e, mu * n_tot * (1 + mu * n_tot / r) AS v FROM w LEFT JOIN {name}_f USING (mot))"


def hurdle(name: str, before: str | None = None, obvious: float = 1e-6) -> str:
    """The same under the hurdle law; ``before``: the round whose obvious days leave."""
    source = f"(SELECT *, used AND NOT coalesce(p < {obvious}, false) AS use FROM {before})" if before else f"(SELECT *, {_USED} AS use FROM w)"
    keep = "mot, date, x, n_tot, use AS used"
    return f"""{name}_u AS (SELECT {keep} FROM {source}), {fitted(name + '_f', f"SELECT mot, x - 1 AS x, n_tot AS n FROM {name}_u WHERE used AND x > 0")},
    {name}_p AS (SELECT mot, avg((x = 0)::INT) AS p0 FROM w GROUP BY mot),
    {name} AS (SELECT u.*, mu, r, p0, CASE WHEN mu IS NULL THEN NULL WHEN x = 0 THEN 1.0 ELSE (1 - p0) * {nb_tail('x - 1', '(mu * n_tot)', 'r')} END AS p,
        (1 - p0) * (1 + mu * n_tot) AS e, (1 - p0) * mu * n_tot * (1 + mu * n_tot / r) + (1 - p0) * p0 * (1 + mu * n_tot) ** 2 AS v
        FROM {name}_u u JOIN {name}_p USING (mot) LEFT JOIN {name}_f USING (mot))"""


def goodness(source: str, free: int) -> str:
    """(mot, chi2, dof, days that left) of a CTE of one of the laws."""
    return f"SELECT mot, sum((x - e) * (x - e) / v) FILTER (used) AS chi2, count(*) FILTER (used) - {free}.0 AS dof, count(*) FILTER (NOT used) AS dropped FROM {source} GROUP BY mot"
