"""Queries that SQL can't say, against NumPy on the rows that they start from."""

import json

import numpy as np
import pandas as pd
import pytest

from gramtide.functions import specfun
from gramtide.operators import corr, laws, peaks, spectral
from gramtide.plans import burst_queries as b
from gramtide.plans import catalog
from gramtide.plans.series_queries import _ranks, array_windows, long_windows
from gramtide.plans.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def z(t):
    df = b._z(t).select("mot", "centre", "w").toPandas().sort_values(["mot", "centre"], ignore_index=True)
    return df, np.stack(df["w"].to_numpy())


@pytest.fixture(scope="module")
def days(t):
    df = b.words(t).toPandas().sort_values(["mot", "date"])
    return {mot: (g["x"].to_numpy(float), g["n_tot"].to_numpy(float), g["date"].to_numpy()) for mot, g in df.groupby("mot")}


@pytest.fixture(scope="module")
def correlations(t):
    wide = _ranks(t).toPandas().pivot(index="date", columns="mot", values="avg_rank")
    return list(wide.columns), np.corrcoef(wide.to_numpy(float), rowvar=False)


def shares(m):
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    return s**2 / (s**2).sum()


def same_spectrum(got, m, column="share"):
    want = shares(m)
    got = got.sort_values("rank")[column].to_numpy()
    assert np.allclose(got, want[: len(got)], atol=1e-8)


# components


def test_spectra(spark, t, z):
    _, m = z
    spectrum = rows(spark, "pca_spectrum").sort_values("rank")
    same_spectrum(spectrum, m)
    comp = np.stack(spectrum["component"].to_numpy())
    assert np.allclose(comp @ comp.T, np.eye(len(comp)), atol=1e-6)
    compare = rows(spark, "norm_compare")
    same_spectrum(compare, m, "z")
    raw = np.stack(array_windows(t).toPandas()["w"].to_numpy())
    spread = raw.max(1) - raw.min(1)
    same_spectrum(compare, ((raw - raw.min(1, keepdims=True)) / spread[:, None])[spread > 0], "minmax")
    wide = long_windows(t).toPandas().pivot(index=["mot", "centre"], columns="j", values="f").to_numpy()
    same_spectrum(compare, (wide - wide.mean(0)) / wide.std(0), "column")


def test_metrics(spark, z):
    share = shares(z[1])
    got, cum = rows(spark, "pca_metrics").iloc[0], share.cumsum()
    assert got.k50 == int(np.argmax(cum >= 0.5)) + 1 and got.k50_share == pytest.approx(got.k50 / 30)
    assert got.effective_rank == pytest.approx(1 / (share**2).sum()) and [got.cum3, got.cum6, got.cum10] == pytest.approx([cum[2], cum[5], cum[9]]) and got.gain6 == pytest.approx(cum[5] / (6 / 30))


def test_null_models_are_spectra_of_what_they_move(spark, t, z):
    turned = np.stack(spectral.rotated(b._z(t), ["mot", "centre"], "w", 2).toPandas()["w"].to_numpy())
    same_spectrum(rows(spark, "null_rotation"), turned)
    mixed = np.stack(spectral.shuffled_columns(b._z(t), ["mot", "centre"], "w", 1).toPandas()["w"].to_numpy())
    same_spectrum(rows(spark, "null_shuffle"), mixed)
    assert np.allclose(np.sort(mixed, axis=0), np.sort(z[1], axis=0)) and np.allclose(np.sort(turned, axis=1).sum(), np.sort(z[1], axis=1).sum())


def test_projections_and_what_follows(spark, t, z):
    df, m = z
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = (u * s)[:, :6]
    want = want * np.where((want**3).sum(0) < 0, -1, 1)
    got = rows(spark, "pca_projections").sort_values(["mot", "centre"], ignore_index=True)
    assert np.allclose(np.stack(got["proj"].to_numpy()), want, atol=1e-6)
    key = list(zip(df.mot, df.centre, strict=True))
    cosine = want / np.linalg.norm(want, axis=1, keepdims=True)
    best = rows(spark, "archetypes")
    for k in range(6):
        mine = best[best["k"] == k].sort_values("rank")
        order = np.argsort(-np.abs(cosine[:, k]), kind="stable")[:3]
        assert np.allclose(np.abs(mine.cosine), np.abs(cosine[order, k]), atol=1e-6) and list(zip(mine.mot, mine.centre, strict=True))[0] == key[order[0]]
    every = u * s
    energy = every**2 / (every**2).sum(1, keepdims=True)
    restored = rows(spark, "reconstruction").sort_values(["mot", "centre"], ignore_index=True)
    for k in (1, 3, 6, 12):
        assert np.allclose(restored[f"k{k}"], energy[:, :k].sum(1), atol=1e-6)
    series = {mot: g.sort_values("date", ignore_index=True) for mot, g in t.series.toPandas().groupby("mot")}
    plane = rows(spark, "event_plane").set_index("mot")
    for mot, g in series.items():
        mine = [c for w, c in key if w == mot]
        if not mine:
            continue
        x, n = g.x.to_numpy(float), g.n_tot.to_numpy(float)
        surprise = np.round(-np.log10(np.maximum(specfun.upper_tail(x, x.sum() / n.sum() * n), 1e-300)), 9)
        centre = max(mine, key=lambda c: (surprise[c], -c))
        at = key.index((mot, centre))
        assert plane.loc[mot].centre == centre and [plane.loc[mot].c1, plane.loc[mot].c2] == pytest.approx(want[at, :2].tolist(), abs=1e-6)


def test_configurations(spark):
    """On the next larger tables: here all days are thin."""
    large = "/root/testdata/sf0.01"
    t, every = Tables(spark, large), catalog.QUERIES["compare_configs"](spark, large).toPandas()
    for name, *config in b.CONFIGS:
        m = np.stack(b.chain(t, *config)["z"].toPandas()["w"].to_numpy())
        assert np.allclose(m.mean(1), 0, atol=1e-9) and np.allclose(m.std(1), 1)
        same_spectrum(every[every.config == name], m)
    for r in catalog.QUERIES["campaign_row"](spark, large).toPandas().itertuples():
        config = next(c for n, *c in b.CONFIGS if n == r.config)
        zz = b.chain(t, *config)["z"]
        m = np.stack(zz.toPandas()["w"].to_numpy())
        turned = np.stack(spectral.rotated(zz, ["mot", "centre"], "w", 2).toPandas()["w"].to_numpy())
        assert r.windows == len(m) and r.cum6 == pytest.approx(shares(m)[:6].sum()) and r.alignment6 == pytest.approx(shares(m)[:6].sum() / shares(turned)[:6].sum())


def test_a_wrong_registry_is_seen(spark, t):
    wrong = spark.createDataFrame([("a", 1)], "config string, expected long")
    got = {r.config: r.ok for r in b.check_configs(t, b.CONFIGS[:2], wrong).collect()}
    assert got == {"a": False, "b": False}


# kernels and correlations


def test_kernels(spark):
    v = np.stack(spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()["embedding"].to_numpy()).astype(float)
    dist = ((v[:, None] - v[None]) ** 2).sum(-1)

    def spectrum(gamma):
        k, h = np.exp(-gamma * dist), np.eye(len(v)) - 1 / len(v)
        return np.linalg.eigvalsh(h @ k @ h)[::-1] / (np.trace(k) - k.sum() / len(v))

    assert np.allclose(rows(spark, "kernel_spectrum").sort_values("rank").share, spectrum(1 / 64)[:30])
    pit = rows(spark, "kernel_pitfall").sort_values("rank")
    assert np.allclose(pit.share_of_kept, spectrum(1 / 64)[:30] / spectrum(1 / 64)[:30].sum())
    for r in rows(spark, "kernel_grid").itertuples():
        cum = spectrum(r.gamma).cumsum()
        assert (r.k50, r.k90) == (int(np.argmax(cum >= 0.5)) + 1, int(np.argmax(cum >= 0.9)) + 1)
    summary = rows(spark, "kernel_summary").set_index("rank")
    for gamma in summary.columns:
        assert np.allclose(summary[gamma].sort_index(), spectrum(float(gamma)).cumsum()[[0, 2, 5, 9]], atol=1e-8)


def plain_linkage(d, cut):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean([d[i][j] for i in x for j in y]), a, c) for a, x in enumerate(groups) for c, y in enumerate(groups) if a < c))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_correlations(spark, t, correlations):
    names, c = correlations
    got = rows(spark, "hier_clusters")
    mine = {frozenset(names.index(w) for w in g.mot) for _, g in got.groupby("cluster")}
    assert mine == plain_linkage(1 - np.abs(c), 0.97) and all(len(g) == n for (_, g), n in zip(got.groupby("cluster"), got.groupby("cluster")["size"].first(), strict=True))
    values, vectors = np.linalg.eigh(c)
    fitted = rows(spark, "mp_fit").sort_values("rank")
    assert np.allclose(fitted.value, values[::-1]) and (fitted.spike == (fitted.value > fitted.high)).all() and (fitted.low < fitted.high).all()
    noise = values <= fitted.high.iloc[0]
    clean = (vectors * np.where(noise, values[noise].mean(), values)) @ vectors.T
    clean = clean / np.sqrt(np.outer(np.diag(clean), np.diag(clean)))
    pairs = rows(spark, "corr_denoise")
    i, j = ([names.index(w) for w in pairs[k]] for k in ("mot_i", "mot_j"))
    assert np.allclose(pairs.r, c[i, j]) and np.allclose(pairs.clean, clean[i, j], atol=1e-9) and len(pairs) == len(names) * (len(names) - 1) // 2
    shift = rows(spark, "denoise_shift").set_index("band")
    band = np.minimum(np.floor(np.abs(pairs.r) / 0.02).astype(int) + 1, 6)
    for k, g in pairs.assign(d=np.abs(pairs.clean - pairs.r)).groupby(band):
        assert shift.loc[k].pairs == len(g) and shift.loc[k].median_shift == pytest.approx(g.d.median())
    axes = rows(spark, "axis_words")
    for k in (1, 2, 3):
        load = np.sort(np.abs(axes[axes.axis == k].loading))[::-1]
        assert np.isclose(load[0], np.abs(vectors[:, -k]).max()) and set(axes[axes.axis == k].side) == {"top", "bottom"}


# laws and peaks


def quantile(law, q, n):
    return int(np.argmax(law.mass(np.arange(20_000), float(n)).cumsum() >= q))


@pytest.mark.parametrize("name,law", [("spike_threshold", "nb"), ("spike_threshold_bnb", "bnb")])
def test_spikes(spark, days, name, law):
    want = {}
    for mot, (x, n, _) in days.items():
        try:
            found = laws.LAWS[law].learn(x, n, n > 0)
        except ValueError:
            continue
        limit = np.array([quantile(found, 0.9999, v) for v in n])
        if (x > limit).any():
            want[mot] = (int((x > limit).sum()), int(limit[x > limit].max()))
    got = {r.mot: (r.spikes, r.threshold) for r in rows(spark, name).itertuples()}
    assert got == want


def test_rolling_spikes(spark, days):
    got = {(r.mot, r.width, str(r.date)[:10]): r.threshold for r in rows(spark, "spikes_rolling").itertuples()}
    want = {}
    for mot, (x, n, d) in days.items():
        for k in (1, 2, 3, 7):
            sx, sn = (np.convolve(v, np.ones(k), "valid") for v in (x, n))
            found = laws.NegativeBinomial(*laws.negative_binomial(sx[::k], sn[::k]))
            for i in np.flatnonzero(sx > 0):
                if (limit := quantile(found, 0.9999, sn[i])) < sx[i]:
                    want[mot, k, str(d[i + k - 1])[:10]] = limit
    assert got == want


def test_rounds_until_nothing_leaves(spark, days):
    for r in rows(spark, "fit_iterated").itertuples():
        x, n, _ = days[r.mot]
        used, gone, turn = n > 0, -1, 0
        try:
            while turn < 6:
                law, turn = laws.Hurdle.learn(x, n, used), turn + 1
                p = law.tail(x, n)
                if int((~used).sum()) == gone:
                    break
                gone = int((~used).sum())
                used_next = used & ~(p < r.limit)
                if turn < 6:
                    used = used_next
        except ValueError:
            assert (r.rounds, r.dropped, r.peaks) == (0, 0, 0)
            continue
        assert (r.rounds, r.dropped, r.peaks) == (turn, gone, int((p < 1e-4).sum()))


def test_sheets_and_reports(spark, t, days):
    fits = {(r.mot, r.law): r for r in peaks.fits(b.words(t), peaks.LAWS).toPandas().itertuples()}
    mass = rows(spark, "peaks_mass")
    for r in rows(spark, "word_sheet").itertuples():
        sheet, (x, n, _) = json.loads(r.sheet), days[r.mot]
        assert {f["law"] for f in sheet["fits"]} == set(peaks.LAWS)
        for f in sheet["fits"]:
            if f.get("chi2") is not None:
                assert f["chi2"] == pytest.approx(fits[r.mot, f["law"]].chi2, rel=1e-6)
        assert len(sheet.get("peaks") or []) == (mass.mot == r.mot).sum() and len(sheet.get("density") or []) <= 800
        assert sheet["mean"] == pytest.approx(x.mean()) and sheet["std"] == pytest.approx(x.std())
    for r in rows(spark, "report_stats").itertuples():
        x = days[r.mot][0]
        assert (r.occurrences, r.active_days, r.days) == (x.sum(), (x > 0).sum(), len(x))
        assert r.poisson == pytest.approx(fits[r.mot, "poisson"].ratio, abs=1e-5) and r.nb == pytest.approx(fits[r.mot, "nb"].ratio, abs=1e-5)


def test_breaks_are_the_best_ones(spark, t):
    got = rows(spark, "break_scan")
    score = lambda x, n: x * np.log(x / n) if x > 0 else 0.0
    for mot, g in t.series.toPandas().groupby("mot"):
        g = g.sort_values("date", ignore_index=True)
        x, n = g.x.to_numpy(float), g.n_tot.to_numpy(float)
        ratio = {k: 2 * (score(x[:k].sum(), n[:k].sum()) + score(x[k:].sum(), n[k:].sum()) - score(x.sum(), n.sum())) for k in range(30, len(x) - 29)}
        best = max(ratio, key=lambda k: (ratio[k], -k))
        mine = got[got.mot == mot]
        if ratio[best] > 6.000001:
            assert best in set(mine.pos) and mine.set_index("pos").loc[best].lrt == pytest.approx(ratio[best], abs=1e-4)
        elif ratio[best] < 5.999:
            assert mine.empty
    assert (got.rejected == (got.p <= got[got.rejected].p.max())).all() if got.rejected.any() else True


def test_the_two_choices(spark, t):
    found = b._candidates(t).toPandas()
    got = {(r.mot, r.pos, r.only) for r in rows(spark, "nms_crosscheck").itertuples()}
    want = set()
    for mot, g in found.groupby("mot"):
        height = {int(p): round(s + 0.0, 2) for p, s in zip(g.pos, np.round(g.surprise, 2), strict=True)}

        def greedy(points, late):
            out = []
            for p in sorted(points, key=lambda p: (-height[p], -p if late else p)):
                if all(abs(p - q) >= 31 for q in out):
                    out.append(p)
            return set(out)

        tops = []
        for p in sorted(height):
            end = p
            while height.get(end + 1) == height[p]:
                end += 1
            if height.get(p - 1, 0) < height[p] > height.get(end + 1, 0) and height[p] >= 1.3:
                tops.append((p + end) // 2)
        a, c = greedy(height, False), greedy(tops, True) if tops else set()
        want |= {(mot, p, "greedy" if p in a else "maxima") for p in a ^ c}
    assert got == want


def test_no_query_is_left_untested():
    here = set(open(__file__).read().replace('"', " ").split())
    without = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert not {name for name in without if name not in here}


def test_share_breaks(spark, t):
    """Against a plain search over both parameters, with the library's own log gamma left out."""
    from math import exp, lgamma, log

    def loglik(rows, mu, w):
        return sum(lgamma(x + mu * w) - lgamma(mu * w) + lgamma(n - x + (1 - mu) * w) - lgamma((1 - mu) * w) - lgamma(n + w) + lgamma(w) for x, n in rows)

    def search(parts):
        """Coordinate steps that halve."""
        at, step = [-3.0] * len(parts) + [4.0], 1.0
        value = lambda v: sum(loglik(p, 1 / (1 + exp(-m)), exp(v[-1])) for p, m in zip(parts, v, strict=False))
        best = value(at)
        while step > 1e-5:
            moved = False
            for k in range(len(at)):
                for s in (step, -step):
                    new = at[:k] + [min(at[k] + s, log(1e7))] + at[k + 1 :]
                    if (v := value(new)) > best + 1e-12:
                        at, best, moved = new, v, True
            step = step if moved else step / 2
        return at, best

    got = rows(spark, "share_break").set_index("mot")
    frame = t.series.toPandas()
    frame["date"] = pd.to_datetime(frame["date"])
    assert set(got.index) == set(frame.mot)
    for mot in sorted(got.index)[:2]:
        g = frame[(frame.mot == mot) & (frame.n_tot > 0)]
        parts = [list(zip(h.x, h.n_tot, strict=True)) for h in (g[g.date < "1995-06-17"], g[g.date >= "1995-06-17"])]
        _, one = search([parts[0] + parts[1]])
        at, two = search(parts)
        mine = got.loc[mot]
        assert mine.lrt == pytest.approx(max(0.0, 2 * (two - one)), abs=2e-3)
        assert [mine.before, mine.after] == pytest.approx([1 / (1 + exp(-m)) for m in at[:2]], rel=1e-2)


def test_share_breaks_hold_their_level():
    """Over-dispersed shares without a break are seldom called broken, which binomial ones would be."""
    from gramtide.operators import shares

    rng, p = np.random.default_rng(5), []
    late = np.arange(300) >= 150
    for _ in range(40):
        n = rng.integers(20, 60, 300)
        p.append(shares.break_test(rng.binomial(n, rng.beta(3, 27, 300)), n, late)[4])
    assert 0.35 < np.mean(p) < 0.65 and np.mean(np.array(p) < 0.05) < 0.15
    n = rng.integers(20, 60, 300)
    before, after, rho, _, q = shares.break_test(rng.binomial(n, rng.beta(np.where(late, 6, 3), np.where(late, 24, 27))), n, late)
    assert q < 1e-3 and abs(before - 0.1) < 0.02 and abs(after - 0.2) < 0.03 and abs(rho - 1 / 31) < 0.015
    assert shares.break_test(np.zeros(4), np.zeros(4), np.zeros(4, bool))[3:] == (0.0, 1.0)
