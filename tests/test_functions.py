import datetime
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramtide.functions import dates, markup, specfun, text
from gramtide.operators import corr, lanczos, laws, monitor, ngrams, peaks, quantiles, series, spectral, urls, vocab, windows
from gramtide.streaming import incremental


def one(spark, column, **values):
    row = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in row.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("M. Dupont U.S.A. est là", ["m", "dupont", "usa", "est", "là"]),
        ("l’été aujourd'hui", ["l'été", "aujourd'hui"]),
        ("œuvre groß a÷b", ["uvre", "gro", "a÷b"]),
        ("vis-à-vis x2", ["vis", "à", "vis", "x2"]),
        ("", []),
    ],
)
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.col("t")), t=raw) == want


def test_sentences_bound_grams(spark):
    df = spark.createDataFrame([("a", 20240101, "un deux. trois\nquatre cinq six"), ("a", 20240101, None), ("a", 20240101, "")], "media string, date int, contenu string")
    got = {r.gram: r.n for r in ngrams.counts(df, 2).collect()}
    assert got == {"un deux": 1, "quatre cinq": 1, "cinq six": 1}
    assert {r.gram for r in ngrams.counts(df, 3).collect()} == {"quatre cinq six"}


def test_capital_dot_with_and_without_lowering_first(spark):
    assert one(spark, text.sentences(F.col("t")), t="A.B c") == ["ab c"]
    assert one(spark, text.plain(F.col("t"), True), t="A.B c") == "a.b c"


@pytest.mark.parametrize("raw,want", [("Été ", "ete"), ("  l'Œuvre  d'Art ", "l'uvre_d'art"), ("Ñandú", "nandu")])
def test_slug(spark, raw, want):
    assert one(spark, text.slug(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("Publié le 30 septembre 2022 - 14:20", "2022-09-30T14:20:00"), ("Publié le 1er mai 2021 - 09:05", "2021-05-01T09:05:00"), ("Publié le 3 foo 2021 - 09:05", "Publié le 3 foo 2021 - 09:05"), ("hier", "hier")])
def test_french_dates(spark, raw, want):
    assert one(spark, text.french_date(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,low,high", [("2020", 20200101, 20201231), ("2020-03", 20200301, 20200331), ("2020-03-14", 20200314, 20200314)])
def test_bounds(spark, raw, low, high):
    assert (dates.parse_bound(raw, False), dates.parse_bound(raw, True)) == (low, high)
    assert one(spark, dates.bound(F.col("t"), True), t=raw) == high


def test_queries_of_more_than_three_words_are_refused():
    assert ngrams.tokenised(["M. X", "l’été"]) == ["m x", "l'été"]
    with pytest.raises(ValueError):
        ngrams.tokenised(["a b c d"])


# special functions


@given(st.floats(1e-3, 1e6))
@settings(max_examples=200, deadline=None)
def test_gammaln(x):
    assert specfun.gammaln(x) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)


@given(st.integers(0, 60), st.floats(0.01, 40), st.floats(0.05, 50))
@settings(max_examples=100, deadline=None)
def test_tails_equal_sums(k, mean, r):
    far = np.arange(k, 60_000)
    assert specfun.upper_tail(k, mean)[()] == pytest.approx(np.exp(specfun.poisson_logpmf(far, mean)).sum(), rel=1e-6, abs=1e-12)
    assert specfun.upper_tail(k, mean, r)[()] == pytest.approx(np.exp(specfun.nb_logpmf(far, mean, r)).sum(), rel=1e-6, abs=1e-8)


def test_tails_far_out():
    assert specfun.upper_tail(200, 20.0)[()] == pytest.approx(4.6635e-124, rel=1e-3)
    assert specfun.upper_tail(0, 0.0)[()] == 1 and specfun.upper_tail(1, 0.0)[()] == 0
    assert specfun.upper_tail(30, 10.0, 1e7)[()] == pytest.approx(specfun.upper_tail(30, 10.0)[()], rel=1e-3)


@pytest.mark.parametrize("x,dof,want", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0, 3, 1.0)])
def test_chi2(x, dof, want):
    assert specfun.chi2_sf(x, dof) == pytest.approx(want, rel=1e-6)


def test_quantile_is_the_least():
    k = specfun.nb_quantile(0.99, 5.0, 2.0)
    assert specfun.upper_tail(k + 1, 5.0, 2.0)[()] <= 0.01 < specfun.upper_tail(k, 5.0, 2.0)[()]


# laws


def test_fit_finds_planted_parameters():
    rng = np.random.default_rng(1)
    n = rng.integers(500, 1500, 4000)
    x = rng.negative_binomial(2.5, 2.5 / (2.5 + 0.01 * n))
    mu, r = laws.negative_binomial(x, n)
    assert mu == pytest.approx(0.01, rel=0.05) and r == pytest.approx(2.5, rel=0.1)
    best = specfun.nb_logpmf(x, mu * n, r).sum()
    for a, b in ((1.01, 1), (0.99, 1), (1, 1.02), (1, 0.98)):
        assert specfun.nb_logpmf(x, mu * a * n, r * b).sum() < best


def test_degenerate_series():
    n = np.full(100, 1000)
    mu, r = laws.negative_binomial(np.full(100, 7), n)
    assert mu == pytest.approx(0.007) and r > 1e5  # underdispersed: Poisson
    with pytest.raises(ValueError):
        laws.negative_binomial(np.zeros(50), n[:50])
    with pytest.raises(ValueError):
        peaks.fit(np.array([0, 0, 3]), np.array([10, 10, 10]), "bnb")


def test_p0_counts_all_days_and_empty_days_have_no_surprise():
    x = np.array([0, 0, 1, 2, 1, 3, 0, 400])
    n = np.full(8, 1000)
    found = peaks.fit(x, n, "bnb", 2)
    assert found.law.p0 == 3 / 8 and (found.p[x == 0] == 1).all() and found.p[-1] == found.p.min()


def test_words_that_cannot_be_fitted_are_rows_with_an_error(spark):
    d = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(5)]
    df = spark.createDataFrame([("zero", x, 0, 10) for x in d] + [("some", x, i, 10 + i) for i, x in enumerate(d)], "mot string, date date, x long, n_tot long")
    got = {r.mot: r.error for r in peaks.fits(df, "nb").collect()}
    assert got["zero"] and got["some"] is None


def test_density_sums_to_one():
    n = np.full(50, 100)
    k, p = laws.mixture(laws.Hurdle(0.5, 0.02, 3.0), np.array([0] * 25 + [3] * 25), n)
    assert p[0] == 0.5 and p.sum() == pytest.approx(1, abs=0.02)


# peaks and windows


def plain_nms(pos, s, reach):
    left, out = set(range(len(pos))), []
    while left:
        i = min(left, key=lambda k: (-s[k], pos[k]))
        near = {k for k in left if abs(pos[k] - pos[i]) < reach}
        out.append((int(pos[i]), len(near) - 1))
        left -= near
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 9)), max_size=40, unique_by=lambda x: x[0]), st.integers(1, 31))
@settings(max_examples=150, deadline=None)
def test_nms(points, reach):
    pos, s = np.array([p for p, _ in points], int), np.array([v for _, v in points], float)
    stay = peaks.thinned(pos, s, reach)
    assert sorted((int(pos[i]), n) for i, n in stay.items()) == plain_nms(pos, s, reach)


def plain_summits(pos, s, least, distance):
    """Every day of the signal looked at: the definition."""
    signal = np.zeros(90)
    signal[pos + 2] = s
    tops = []
    for a in range(1, 88):
        b = a
        while signal[b + 1] == signal[a]:
            b += 1
            if b == 88:
                break
        if b < 88 and signal[a] >= max(least, 1e-9) and signal[a - 1] < signal[a] > signal[b + 1]:
            tops.append((a + b) // 2 - 2)
    out = []
    for p in sorted(tops, key=lambda p: (-signal[p + 2], -p)):
        if all(abs(p - q) >= distance for q in out):
            out.append(p)
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 80), st.integers(1, 6)), max_size=60, unique_by=lambda x: x[0]), st.integers(1, 31), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_summits(points, distance, least):
    pos, s = np.array([p for p, _ in points], int), np.array([v for _, v in points], float)
    assert peaks.summits(pos, s, least, distance) == plain_summits(pos, s, least, distance)


def test_greedy_choice_and_tops_can_differ(spark):
    rows = [("w", p, v) for p, v in ((0, 10.0), (30, 9.0), (31, 8.0))]
    got = peaks.crosscheck(spark.createDataFrame(rows, "mot string, pos long, surprise double"), 1.0, 31).collect()
    assert [tuple(r) for r in got] == [("w", 31, "greedy")]


def test_peaks_at_the_exact_reach_survive():
    assert peaks.thinned(np.array([0, 30, 31]), np.array([9.0, 5.0, 5.0]), 31) == {0: 1, 2: 0}


def test_polygammas():
    x = np.array([1e-4, 0.3, 1.0, 5.5, 1e3, 1e6])
    h = x * 1e-5
    assert specfun.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12) and specfun.trigamma(1.0) == pytest.approx(np.pi**2 / 6, abs=1e-12)
    assert np.allclose(specfun.digamma(x + 1), specfun.digamma(x) + 1 / x, rtol=1e-11) and np.allclose(specfun.trigamma(x), (specfun.digamma(x + h) - specfun.digamma(x - h)) / (2 * h), rtol=1e-4)


def test_tails_by_sums():
    for mean, r in ((0.3, None), (40.0, None), (7.0, 0.4), (90.0, 12.0)):
        k = np.arange(0, 60)
        pmf = np.exp(specfun.poisson_logpmf(np.arange(4000), mean) if r is None else specfun.nb_logpmf(np.arange(4000), mean, r))
        assert np.allclose(specfun.upper_tail(k, mean, r), pmf[::-1].cumsum()[::-1][:60], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("q", [0.2, 0.5, 0.51, 0.9, 0.9999])
def test_quantile_uses_up_p0_first(q):
    law = laws.Hurdle(0.5, 0.02, 3.0)
    k = np.arange(400)
    assert law.quantile(q, 100) == int(np.argmax(law.mass(k, 100.0).cumsum() >= q))


def test_moments_follow_from_the_mass():
    k = np.arange(3000)
    for law in (laws.Poisson(0.02), laws.NegativeBinomial(0.02, 3.0), laws.Hurdle(0.4, 0.02, 3.0)):
        p = law.mass(k, 200.0)
        mean, variance = law.moments(200.0)
        assert p.sum() == pytest.approx(1) and (k * p).sum() == pytest.approx(mean) and ((k - mean) ** 2 * p).sum() == pytest.approx(variance)
        assert law.tail(np.array([3.0]), np.array([200.0]))[0] == pytest.approx(p[3:].sum())


def test_breaks_are_found():
    rng = np.random.default_rng(8)
    n = np.full(900, 1000.0)
    x = rng.poisson(np.repeat([0.004, 0.02, 0.006], 300) * n)
    days = [d for d, *_ in peaks.segmented(x, n, 20.0)]
    assert len(days) == 2 and abs(days[0] - 300) < 5 and abs(days[1] - 600) < 10
    assert peaks.segmented(rng.poisson(5, 900), n, 25.0) == []


def test_p_values_of_the_scan_are_uniform_without_a_break():
    """The law of one known date calls most of these series broken; that of the best date does not."""
    rng, n, p, naive = np.random.default_rng(12), np.full(240, 1000.0), [], []
    for k in range(150):
        x = rng.poisson(5.0, 240).astype(float)
        ratio = peaks.break_scan(x, n, 30)[1]
        p.append(peaks.scan_p(x, n, ratio, 30, 99, 7, k))
        naive.append(peaks.sf.chi2_sf(ratio, 1))
    p = np.array(p)
    assert 0.4 < p.mean() < 0.6 and (p <= 0.05).mean() < 0.12 and 0.1 < (p <= 0.25).mean() < 0.4 and (np.array(naive) <= 0.05).mean() > 0.2
    broken = rng.poisson(np.repeat([4.0, 7.0], 120)).astype(float)
    assert peaks.scan_p(broken, n, peaks.break_scan(broken, n, 30)[1], 30, 99, 7) == 0.01
    assert peaks.scan_p(np.zeros(20), np.zeros(20), 0.0) == 1


def test_sitemap_tree_with_cycles(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "r"), ("d", "d"), ("x", "y"), ("d", "e"), ("e", "f"), ("f", "g")]
    df = spark.createDataFrame([(*e, "2024-06-01") for e in edges] + [("r", "old", "2020-01-01")], "parent string, child string, lastmod string")
    roots = spark.createDataFrame([("r",), ("r",)], "node string")
    got = {r.node: r.depth for r in urls.tree(df, roots, "2024-05").collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": 6}
    assert {r.node for r in urls.tree(df, roots, "2024-05", 2).collect()} == {"r", "a", "b"}
    assert urls.tree(df, roots.limit(0), "2024-05").count() == 0


@pytest.mark.parametrize("few", [1, 5, 8192])
def test_exact_quantiles(spark, few):
    rng, qs = np.random.default_rng(13), (0.0, 0.01, 0.333, 0.5, 0.9, 1.0)
    groups = {"a": rng.standard_normal(700), "b": np.full(300, 2.5), None: np.round(rng.exponential(3, 400)), "one": np.array([7.0]), "far": np.append(rng.standard_normal(300), [1e12, -1e9])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.v for r in quantiles.exact(df, ["g"], "x", qs, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, qs)), rel=1e-12, abs=1e-12), g
    every = np.concatenate(list(groups.values()))
    assert quantiles.exact(df, [], "x", qs, few).first().v == pytest.approx(list(np.quantile(every, qs)), rel=1e-12, abs=1e-12)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    got = {r.p: r.rejected for r in peaks.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p double"), "p").collect()}
    assert [v for v in p if got[v]] == [0.001, 0.008]


def grid(spark, n=10):
    return spark.range(n).select(F.lit("m").alias("mot"), F.col("id").alias("pos"), (F.col("id") * F.col("id")).cast("double").alias("f"), F.when(F.col("id").isin(3, 4), 1).otherwise(100).alias("n_tot"))


def test_windows_at_the_edges_are_dropped(spark):
    centres = spark.createDataFrame([("m", 1), ("m", 2), ("m", 7), ("m", 8)], "mot string, pos long")
    got = windows.windows_long(centres, grid(spark), 2).groupBy("centre").count().collect()
    assert {r["centre"]: r["count"] for r in got} == {2: 5, 7: 5}
    assert windows.windows_array(grid(spark), 2).count() == 6


def test_thin_days_are_interpolated_and_thin_centres_dropped(spark):
    centres = spark.createDataFrame([("m", 2), ("m", 3), ("m", 5)], "mot string, pos long")
    long = windows.windows_long(centres, grid(spark), 2).withColumn("pos", F.col("centre") + F.col("j")).join(grid(spark).select("pos", "n_tot"), "pos")
    got = {(r["centre"], r["j"]): r["f"] for r in windows.interpolate_thin(long, 50).collect()}
    assert {c for c, _ in got} == {2, 5}
    assert got[2, 1] == 4 and got[2, 2] == 4  # the end holds the last full day
    assert got[5, -2] == 25 and got[5, -1] == 25 and got[5, 0] == 25


def test_z_scores_drop_flat_windows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [5.0, 5.0, 5.0])], "k int, w array<double>")
    got = windows.z_scores(df).collect()
    assert [r.k for r in got] == [1] and np.allclose(got[0].w, [-1.224744871, 0, 1.224744871])
    assert [r.k for r in windows.min_max(df).collect()] == [1]


@pytest.mark.parametrize("by,want", [(0, [1, 2, 3]), (1, [3, 1, 2]), (5, [2, 3, 1]), (-1, [2, 3, 1])])
def test_roll(spark, by, want):
    assert one(spark, windows.roll(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(by))) == want


def test_no_exposure_gives_null(spark):
    assert one(spark, series.freq(F.lit(3), F.lit(0))) is None


# matrices


def test_components_equal_a_decomposition(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((200, 6)) @ np.diag([5, 3, 2, 1, 1, 0.5])
    df = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(m)], "k long, w array<double>").repartition(3)
    got = spectral.components(df, "w", []).orderBy("rank").collect()
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    assert np.allclose([r.share for r in got], s**2 / (s**2).sum())
    proj = np.array([r.proj for r in spectral.projections(df, "w", spectral.components(df, "w", []), 6).orderBy("k").collect()])
    assert np.allclose((proj**2).sum(0), s**2) and np.allclose(proj @ np.array([r.component for r in got]), m - m.mean(0))


def test_null_models_keep_their_marginals(spark):
    m = np.arange(60, dtype=float).reshape(20, 3)
    df = spark.createDataFrame([(int(i), row.tolist()) for i, row in enumerate(m)], "k long, w array<double>")
    shuffled = np.array([r.w for r in spectral.shuffled_columns(df, ["k"], "w", 1).orderBy("k").collect()])
    assert (np.sort(shuffled, axis=0) == m).all() and not (shuffled == m).all()
    turned = np.array([r.w for r in spectral.rotated(df, ["k"], "w", 1).orderBy("k").collect()])
    assert (np.sort(turned, axis=1) == m).all()


def test_kernel_shares_sum_to_one(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(rng.standard_normal(4).tolist(),) for _ in range(40)], "z array<double>")
    got = spectral.kernel_spectra(df, "z", [0.3], 40).agg(F.sum("share")).first()[0]
    assert got == pytest.approx(1)


def plain_linkage(d, cut):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min((np.mean([d[i][j] for i in x for j in y]), a, c) for a, x in enumerate(groups) for c, y in enumerate(groups) if a < c)
        if best[0] > cut:
            break
        groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed,cut", [(1, 0.85), (2, 0.97), (3, 0.5), (4, 0.99)])
def test_average_linkage(spark, seed, cut):
    rng = np.random.default_rng(seed)
    near = np.abs(np.corrcoef(rng.standard_normal((6, 14)) + 2 * rng.standard_normal((6, 4))[:, rng.integers(0, 4, 14)], rowvar=False))
    near[near < 0.1] = 0  # pairs that aren't there
    rows = [(f"w{i:02}", f"w{j:02}", float(near[i, j])) for i in range(14) for j in range(i + 1, 14) if near[i, j]]
    words = spark.createDataFrame([(f"w{i:02}",) for i in range(15)], "mot string")  # w14 is near none
    got = corr.average_linkage(spark.createDataFrame(rows, "mot_i string, mot_j string, s double"), words, cut).toPandas()
    mine = {frozenset(int(w[1:]) for w in g.mot) for _, g in got.groupby("cluster")}
    assert mine == plain_linkage(1 - near, cut) | {frozenset([14])}
    assert all(len(g) == g["size"].iloc[0] and g.mot.min() == k for k, g in got.groupby("cluster"))


@pytest.mark.parametrize("panel", [1, 2000, 1 << 22])
def test_lanczos_equals_a_dense_spectrum(panel):
    rng = np.random.default_rng(8)
    for values in (np.geomspace(100, 1e-3, 150), np.repeat([5.0, 3.0, 1.0], 50), np.concatenate([[40, 39.99], rng.uniform(0, 2, 148)])):
        q = np.linalg.qr(rng.standard_normal((150, 150)))[0]
        m = (q * values) @ q.T
        found = lanczos.spectrum(lambda v: m @ v, 150, 12, panel=panel)  # noqa: B023
        want = np.sort(values)[::-1]
        assert np.allclose(found.values[:12], want[:12], atol=1e-8 * want[0]) and found.weights.sum() == pytest.approx(150)
        assert np.allclose(m @ found.vectors[:, :12], found.vectors[:, :12] * found.values[:12], atol=1e-6 * want[0])
        assert (found.weights * found.nodes).sum() == pytest.approx(values.sum(), rel=0.15)
        if found.whole:
            assert np.allclose(np.sort(found.values), np.sort(values), atol=1e-8 * want[0])
    with pytest.raises(ValueError):
        lanczos.spectrum(lambda v: m @ v, 150, 100, panel=1, most=150 * 20)


def test_kernel_by_steps(spark, monkeypatch):
    """Blocks of a few vectors and panels of a few columns give what one dense matrix does."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal((300, 6)), np.zeros((40, 6))])  # copies are no hot key
    df = spark.createDataFrame([(x.tolist(),) for x in v], "z array<double>")
    k, h = np.exp(-0.2 * ((v[:, None] - v[None]) ** 2).sum(-1)), np.eye(len(v)) - 1 / len(v)
    want = np.linalg.eigvalsh(h @ k @ h)[::-1] / (np.trace(k) - k.sum() / len(v))
    monkeypatch.setattr(spectral, "SPECTRUM_BLOCK", 90)
    got = spectral.kernel_spectra(df, "z", [0.2], 30, panel=340 * 40).orderBy("rank").toPandas()
    assert np.abs(got.share - want[:30]).max() < 1e-8
    assert spectral.kernel_spectra(df.limit(0), "z", [0.2]).count() == 0


def test_correlation_spectrum_by_steps(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((90, 40)) + 2 * rng.standard_normal((90, 1)) * (np.arange(40) < 9)
    df = spark.createDataFrame([(f"w{j:02}", i, float(x[i, j])) for i in range(90) for j in range(40)] + [("flat", i, 1.0) for i in range(90)], "mot string, date int, v double")
    c = np.corrcoef(x, rowvar=False)
    want, vectors = np.linalg.eigh(c)
    for panel in (40 * 8, 1 << 22):
        found, words, days = corr.spectrum(df, "v", 3, panel=panel)
        assert words == [f"w{j:02}" for j in range(40)] and days == 90 and np.allclose(found.values[:3], want[::-1][:3], atol=1e-8)
    monkeypatch.setattr(corr, "TILE_WORDS", 7)
    monkeypatch.setattr(corr, "TILE_DAYS", 25)
    got = corr.denoised(df, "v").toPandas()
    values, vecs, rest = corr.spikes(found, 90)
    m = (vecs * (values - rest)) @ vecs.T + rest * np.eye(40)
    m = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
    i, j = (got[k].str[1:].astype(int).to_numpy() for k in ("mot_i", "mot_j"))
    assert len(got) == 780 and np.allclose(got.r, c[i, j]) and np.allclose(got.clean, m[i, j]) and len(values) < 40


def test_correlations_over_common_days(spark, monkeypatch):
    monkeypatch.setattr(corr, "TILE_WORDS", 3)
    monkeypatch.setattr(corr, "TILE_DAYS", 10)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((40, 9)) + 1e4
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:20, 7], x[20:, 8] = np.nan, np.nan  # no common day
    x[:, 6] = 5.0
    df = spark.createDataFrame([(f"w{j}", i, float(x[i, j])) for i in range(40) for j in range(9) if not np.isnan(x[i, j])], "mot string, date int, v double")
    got = {(r.mot_i, r.mot_j): r.r for r in corr.pairs(df, "v").collect()}
    assert len(got) == 35
    for (a, b), r in got.items():
        both = x[:, [int(a[1]), int(b[1])]]
        both = both[~np.isnan(both).any(1)]
        assert r is None if "w6" in (a, b) else r == pytest.approx(np.corrcoef(both, rowvar=False)[0, 1], abs=1e-9)
    near = corr.neighbours(df, "v", 3).collect()
    for w in range(9):
        want = sorted(((-round(r, 9), (set(k) - {f"w{w}"}).pop()) for k, r in got.items() if f"w{w}" in k and r is not None))[:3]
        assert [(-round(r.r, 9), r.other) for r in sorted(near, key=lambda r: r["rank"]) if r.mot == f"w{w}"] == want


def test_noise_edge_holds_white_noise():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 60))
    values = np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))
    s2, q, low, high = corr.fit_noise(values, 60 / 4000)
    assert s2 == pytest.approx(1, abs=0.1) and q == pytest.approx(60 / 4000, rel=0.3) and (values <= high * 1.05).all() and (values >= low * 0.9).all()
    spiked = np.append(values, [9.0, 30.0])
    assert (spiked > corr.fit_noise(spiked, 60 / 4000)[3]).sum() <= 4 and (spiked[-2:] > corr.fit_noise(spiked, 60 / 4000)[3]).all()
    whole = lanczos.spectrum(lambda v: np.corrcoef(x, rowvar=False) @ v, 60, 60)
    assert len(corr.spikes(whole, 4000)[0]) <= 2


def test_noise_density_is_a_density():
    for s2, q in ((1.0, 0.1), (0.7, 0.5), (2.0, 0.9)):
        low, high = corr.noise_edges(s2, q)
        x = np.linspace(max(low, 1e-6), high, 400_001)
        p = corr.noise_density(x, s2, q)
        assert np.trapezoid(p, x) == pytest.approx(1, abs=5e-3) and np.trapezoid(p * x, x) == pytest.approx(s2, rel=5e-3)


def test_components_are_oriented(spark):
    df = spark.createDataFrame([(1, [3.0, -1.0]), (2, [-1.0, 2.0]), (3, [-1.0, -5.0])], "k int, proj array<double>")
    assert {r.k: r.proj for r in spectral.oriented(df).collect()} == {1: [3.0, 1.0], 2: [-1.0, -2.0], 3: [-1.0, 5.0]}


def test_correlations_of_a_frame(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 3))
    rows = [(f"w{j}", i, float(x[i, j])) for i in range(30) for j in range(3)]
    got = {(r.mot_i, r.mot_j): r.r for r in corr.pairs(spark.createDataFrame(rows, "mot string, date int, v double"), "v").collect()}
    c = np.corrcoef(x, rowvar=False)
    assert all(got[f"w{i}", f"w{j}"] == pytest.approx(c[i, j]) for i in range(3) for j in range(i + 1, 3))


# collection


def test_states(spark):
    rows = [(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (4, 1, False), (4, 2, False)]
    got = {r.id: r.state for r in urls.state_after(spark.createDataFrame(rows, "id long, at long, ok boolean")).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 4}


def test_clamped_intervals_and_short_histories(spark):
    rows = [("m", i, i, ok, bad) for i, (ok, bad) in enumerate([(0, 0), (5, 5), (9, 3), (9, 3), (10, 13)])]
    got = monitor.intervals(spark.createDataFrame(rows, "media string, ts long, event_id long, ok long, bad long")).orderBy("batch").collect()
    assert [(r.batch, r.n, round(r.rate, 3)) for r in got] == [(1, 10, 0.5), (2, 4, 1.0), (3, 11, 0.091)]
    assert monitor.control_chart(monitor.intervals(spark.createDataFrame(rows, "media string, ts long, event_id long, ok long, bad long"))).count() == 0


@pytest.mark.parametrize("url,want", [("https://x.fr/", True), ("https://video.x.fr/a/b", True), ("https://x.fr/a/b.PDF", True), ("https://x.fr/a?img=b.pdf", False), ("https://x.fr/ma-video-a-moi", False), ("https://x.fr/live/1", True), ("https://x.fr/a%20http://b", True)])
def test_not_articles(spark, url, want):
    assert one(spark, urls.not_article(F.col("u"), F.lit("m"), {"m": ("/live/",)}), u=url) is want


def test_blocked(spark):
    signals = ("pour lire la suite",)
    for t, want in (("", True), (" \n ", True), ("x" * 500 + " Pour lire la suite", True), ("pour lire la suite" + "x" * 500, False), ("normal", False)):
        assert one(spark, markup.blocked(F.col("t"), signals), t=t) is want


PAGE = """<html><head><title>T</title><script type="application/ld+json">{oops</script>
<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["NewsArticle"], "headline": "H &amp; co", "author": [{"name": "A"}, "B"],
"articleSection": ["x", "y"], "isAccessibleForFree": "False"}]}</script></head>
<body><div class="ad"><p>no</p></div><article class="main big"><p>one <b>two</b><p>three</p><script>var p = "<p>";</script><time datetime="2024-01-02">hier</time></article></body></html>"""


def test_extraction():
    got = markup.extract(PAGE)
    assert got == {"titre": "H &amp; co", "auteur": "A, B", "date": "2024-01-02", "section": "x, y", "free": "non", "contenu": "one two\nthree"}
    assert markup.extract(PAGE, "article.big", "three")["contenu"] == "one two"
    assert markup.extract("")["contenu"] == "" and markup.extract("<p>a")["contenu"] == ""
    assert markup._containers(PAGE)[0] == ("article", 3)


def test_new_ids_follow_the_largest(spark):
    known = spark.createDataFrame([(5, "b")], "id long, word string")
    words = spark.createDataFrame([("c",), ("a",), ("b",), ("aa",), ("c",)], "word string")
    assert [(r.word, r.id) for r in vocab.new_ids(known, words).orderBy("id").collect()] == [("a", 6), ("aa", 7), ("c", 8)]
    assert {r.id for r in vocab.new_ids(known.limit(0), words).collect()} == {1, 2, 3, 4}


@given(st.lists(st.integers(0, 63), max_size=80), st.integers(1, 20))
@settings(max_examples=50, deadline=None)
def test_slices_hold_everything_once(values, full):
    got = incremental.bisect(lambda a, b: sum(a <= v < b for v in values), 0, 64, full)
    assert sum(n for *_, n in got) == len(values)
    assert all(n < full or b - a == 1 for a, b, n in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_slices_of_a_table_equal_the_walk(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 64, 200).tolist() + [7] * 50
    df = spark.createDataFrame([(int(v),) for v in values], "at long")
    got = sorted((r.a, r.b, r.n) for r in incremental.bisected(df, "at", 20, 6).collect())
    assert got == incremental.bisect(lambda a, b: sum(a <= v < b for v in values), 0, 64, 20)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", 20240101, "a b"), (2, "m", 20240101, "a"), (2, "m", 20240101, "a")], "id long, media string, date int, contenu string")
    store = str(tmp_path / "s")
    assert incremental.upsert(df.where("id = 1"), store, 0) and incremental.upsert(df, store, 1) and incremental.upsert(df, store, 1)
    assert not incremental.upsert(df, store, 2)
    assert {r.gram: r.n for r in incremental.stored_counts(spark, store).collect()} == {"a": 2, "b": 1}
    incremental.compact(spark, store, str(tmp_path / "c"))
    assert {r.gram: r.n for r in incremental.stored_counts(spark, str(tmp_path / "c")).collect()} == {"a": 2, "b": 1}


def test_writers(spark, tmp_path):
    from gramtide.sources import writers

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert writers.append_new(rows, path, ["k"]) == 2 and writers.append_new(rows, path, ["k"]) == 0
    out = str(tmp_path / "e")
    assert writers.publish_if_changed(rows, out) and not writers.publish_if_changed(rows, out) and writers.publish_if_changed(rows.limit(1), out)
    assert pd.notna(writers.digest(rows).first()["hash"])
