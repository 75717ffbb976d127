"""Fits, peaks, windows of peaks, components, kernels and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import corr, ngrams, peaks, quantiles, series, shares, spectral, vocab, windows
from ..operators.lineage import cut, scratch, sized_join
from . import law_sql
from .registry import query, sql
from .series_queries import _ranks, _spearman, array_windows, long_windows
from .tables import Tables

MIN_DAYS = 60


def words(t: Tables) -> DataFrame:
    """Dense series (mot, date, x, n_tot) of the words with 60 active days or more; mot is ``media:word``."""
    uni = t.once("uni", lambda: _stored(t.uni))  # counted once for totals, choice and series
    chosen = vocab.census(uni).where((F.col("active_days") >= MIN_DAYS) & vocab.admissible(F.col("gram"))).select("media", "gram")
    long = vocab.matrix_long(uni, ngrams.daily_totals(uni), chosen)
    return long.select(F.concat_ws(":", "media", "gram").alias("mot"), dates.to_day(F.col("date")).alias("date"), F.col("n").alias("x"), F.col("total").alias("n_tot"))


def _stored(df: DataFrame) -> DataFrame:
    """A wide table as Parquet in the shared folder: a checkpoint would be some times as large."""
    path = scratch(df.sparkSession, "uni")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def found(t: Tables, law: str = "bnb", rounds: int = 2) -> DataFrame:
    return peaks.daily_pvalues(words(t), law, rounds, peaks.THRESHOLD)


def _poisson(source: str) -> str:
    """(mot, date, x, n_tot, p) of a dense series by SQL: one minus the terms under x, for counts that allow it."""
    m = "(x_sum / n_sum * n_tot)"
    return f"SELECT mot, date, x, n_tot, CASE WHEN x = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, x), lambda k: exp(k * ln({m}) - {m} - lgamma(k + 1))))) END AS p FROM (SELECT *, sum(x) OVER (PARTITION BY mot)::DOUBLE AS x_sum, sum(n_tot) OVER (PARTITION BY mot)::DOUBLE AS n_sum FROM {source})"


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"(SELECT t.media || ':' || c.gram AS mot, strptime(t.date::VARCHAR, '%Y%m%d')::DATE AS date, coalesce(u.n, 0)::BIGINT AS x, t.total AS n_tot FROM (SELECT media, gram FROM cens WHERE active_days >= {MIN_DAYS} AND gram NOT IN ({_STOP}) AND NOT regexp_matches(gram, '^[0-9]') AND length(gram) > 1) c JOIN tot t USING (media) LEFT JOIN uni u ON u.media = t.media AND u.gram = c.gram AND u.date = t.date)"


def _laws(body: str, *ctes: str) -> str:
    """A query over the words' days w and CTEs of laws."""
    return sql("\0", "uni", "tot", "cens").replace("WITH ", "WITH RECURSIVE ", 1).replace("\0", f", w AS MATERIALIZED (SELECT * FROM {_WORDS}), " + ",\n".join(ctes) + "\n" + body)


_FIT = {"fit_nb": ("nb", 1, (law_sql.nb("a"),), 2), "fit_bnb": ("bnb", 1, (law_sql.hurdle("a"),), 3), "fit_bnb2": ("bnb", 2, (law_sql.hurdle("b"), law_sql.hurdle("a", "b")), 3)}
_ERROR = "too few counts for a fit"


def _number(name: str, digits: int) -> F.Column:
    """Null where there is no fit."""
    return F.when(~F.isnan(name), F.round(name, digits)).alias(name)


for _name, (_law, _rounds, _ctes, _free) in _FIT.items():
    query(
        _name,
        _laws(
            f"""SELECT mot, '{_law}' AS law, round(mu, 8) AS mu, round(least(r, 1000.0), 2) AS r, CASE WHEN mu IS NOT NULL THEN round(p0, 8) END AS p0, CASE WHEN mu IS NOT NULL THEN round(chi2, 3) END AS chi2, CASE WHEN mu IS NOT NULL THEN dof END AS dof,
            CASE WHEN mu IS NOT NULL THEN dropped ELSE 0 END AS dropped, CASE WHEN mu IS NULL THEN '{_ERROR}' END AS error FROM ({law_sql.goodness("a", _free)}) JOIN (SELECT mot, any_value(mu) AS mu, any_value(r) AS r, any_value(p0) AS p0 FROM a GROUP BY mot) USING (mot)""",
            *_ctes,
        ),
    )(lambda t, law=_law, n=_rounds: peaks.fits(words(t), law, n).withColumn("r", F.least("r", F.lit(1000.0))).select("mot", "law", _number("mu", 8), _number("r", 2), _number("p0", 8), _number("chi2", 3), _number("dof", 0), "dropped", "error"))


@query("fit_iterated")
def fit_iterated(t: Tables):
    """Rounds until no more days leave, for three limits of the obvious."""
    return peaks.iterated(words(t), limits=(1e-5, 1e-6, 1e-7))


for _name, _law, _cte in (("pvalues_nb", "nb", law_sql.nb("a")), ("pvalues_bnb", "bnb", law_sql.hurdle("a"))):
    query(_name, _laws("SELECT mot, date, x, n_tot, round(p, 4) AS p FROM a WHERE p IS NOT NULL", _cte))(lambda t, law=_law: peaks.daily_pvalues(words(t), law).select("mot", "date", "x", "n_tot", F.round("p", 4).alias("p")))


@query("pvalues_poisson", sql(f"SELECT mot, date, x, n_tot, round(p, 8) AS p FROM ({_poisson(_WORDS)})", "uni", "tot", "cens"))
def pvalues_poisson(t: Tables):
    return peaks.daily_pvalues(words(t), "poisson").select("mot", "date", "x", "n_tot", F.round("p", 8).alias("p"))


_TWICE = (law_sql.hurdle("b"), law_sql.hurdle("a", "b"))
_PLACED = "(SELECT *, row_number() OVER (PARTITION BY mot ORDER BY date) - 1 AS pos FROM a)"


@query("peaks_mass", _laws(f"SELECT mot, date, pos, x, n_tot, round(1e5 * x / n_tot, 6) AS f, round(p, 10) AS p FROM {_PLACED} WHERE p < {peaks.THRESHOLD}", *_TWICE))
def peaks_mass(t: Tables):
    return found(t).select("mot", "date", "pos", "x", "n_tot", F.round("f", 6).alias("f"), F.round("p", 10).alias("p"))


@query("peaks_top30", _laws("SELECT mot, date, x, n_tot, round(p, 5) AS p FROM a WHERE p < 0.05 QUALIFY row_number() OVER (PARTITION BY mot ORDER BY p, date) <= 30", *_TWICE))
def peaks_top30(t: Tables):
    return peaks.top_peaks(peaks.daily_pvalues(words(t), "bnb", 2, 0.05)).select("mot", "date", "x", "n_tot", F.round("p", 5).alias("p")).orderBy("mot", "date")


@query("worst_day", _laws("SELECT mot, date, round(p, 5) AS p FROM a WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mot ORDER BY p, date) = 1", law_sql.nb("a")))
def worst_day(t: Tables):
    return peaks.daily_pvalues(words(t), "nb").groupBy("mot").agg(F.min_by(F.struct("date", "p"), F.struct("p", "date")).alias("s")).select("mot", "s.date", F.round("s.p", 5).alias("p"))


_CURVE = f"""SELECT mot, k, round(CASE WHEN k = 0 THEN any_value(p0) ELSE (1 - any_value(p0)) * avg({law_sql.nb_mass("greatest(k - 1, 0)", "(mu * n_tot)", "r")}) END, 6) AS p
    FROM a JOIN (SELECT mot, unnest(range(greatest(0, hi - 30000), hi, greatest(1, ceil(least(hi, 30000) / 800.0)::BIGINT))) AS k FROM (SELECT mot, floor(max(x) * 1.3)::BIGINT + 6 AS hi FROM w GROUP BY mot)) USING (mot) WHERE mu IS NOT NULL GROUP BY mot, k"""


@query("mixture_density", _laws(_CURVE, law_sql.hurdle("a")))
def mixture_density(t: Tables):
    return peaks.mixture_density(words(t), "bnb").withColumn("p", F.round("p", 6))


@query("spike_threshold")
def spike_threshold(t: Tables):
    return peaks.rolling_spikes(words(t), (1,)).groupBy("mot").agg(F.count("*").alias("spikes"), F.max("threshold").alias("threshold"))


@query("spike_threshold_bnb")
def spike_threshold_bnb(t: Tables):
    """The threshold under the hurdle law: p0 is used up first, what is left of q is asked of the active days' law."""
    return peaks.rolling_spikes(words(t), (1,), law="bnb").groupBy("mot").agg(F.count("*").alias("spikes"), F.max("threshold").alias("threshold"))


@query("share_break")
def share_break(t: Tables):
    """Each brand's share of its family before and after a known date, under the beta-binomial law."""
    return shares.breaks_at(t.series, "1995-06-17")


@query("break_scan")
def break_scan(t: Tables):
    """Breaks of each word's rate by binary segmentation; those that hold when all dates are tested together."""
    return peaks.benjamini_hochberg(peaks.breaks(t.series, 6.0), "p").withColumn("lrt", F.round("lrt", 6))


@query("spikes_rolling")
def spikes_rolling(t: Tables):
    return peaks.rolling_spikes(words(t))


_GOODNESS = f"SELECT mot, chi2, dof, chi2 / dof AS ratio, {law_sql.chi2_upper('chi2', 'dof')} AS p_gof FROM ({{}}) WHERE chi2 IS NOT NULL"


@query("gof_kept", _laws(f"SELECT count(*) AS kept, round(min(ratio), 5) AS least, round(max(ratio), 5) AS largest FROM ({_GOODNESS.format(law_sql.goodness('a', 2))}) WHERE p_gof >= 0.05", law_sql.nb("a")))
def gof_kept(t: Tables):
    """Words that the test of fit doesn't reject, and the least and largest of their ratios."""
    rows = peaks.fits(words(t), "nb").where("p_gof >= 0.05")
    return rows.agg(F.count("*").alias("kept"), F.round(F.min("ratio"), 5).alias("least"), F.round(F.max("ratio"), 5).alias("largest"))


_COMPARED = " UNION ALL ".join(f"SELECT m.mot, '{law}' AS law, round(chi2, 3) AS chi2, CASE WHEN chi2 IS NOT NULL THEN dof END AS dof, round(ratio, 5) AS ratio, round(p_gof, 6) AS p_gof, CASE WHEN chi2 IS NULL THEN '{_ERROR}' END AS error FROM (SELECT DISTINCT mot FROM w) m LEFT JOIN ({_GOODNESS.format(law_sql.goodness(name, free))}) USING (mot)" for law, name, free in (("poisson", "p", 1), ("nb", "a", 2), ("bnb", "c", 3)))


@query("law_compare", _laws(_COMPARED, law_sql.poisson("p"), law_sql.nb("a"), law_sql.hurdle("c")))
def law_compare(t: Tables):
    rows = peaks.fits(words(t), peaks.LAWS)
    return rows.select("mot", "law", _number("chi2", 3), _number("dof", 0), _number("ratio", 5), _number("p_gof", 6), "error")


@query("report_stats")
def report_stats(t: Tables):
    """Totals, moments and the three fits of each word."""
    s = words(t)
    fit = law_compare(t).groupBy("mot").pivot("law", list(peaks.LAWS)).agg(F.first("ratio"))
    stats = s.groupBy("mot").agg(F.sum("x").alias("occurrences"), F.count_if(F.col("x") > 0).alias("active_days"), F.count("*").alias("days"))
    return stats.join(series.moments(s, "x"), "mot").join(fit, "mot")


@query("report_peaks", _laws(f"SELECT mot, date, x, n_tot, round(p, 10) AS p, row_number() OVER (PARTITION BY mot ORDER BY p, date) AS rank FROM a WHERE p < {peaks.THRESHOLD}", *_TWICE))
def report_peaks(t: Tables):
    # by p itself: surprise ends at 300
    return found(t).select("mot", "date", "x", "n_tot", F.round("p", 10).alias("p"), F.row_number().over(Window.partitionBy("mot").orderBy("p", "date")).alias("rank"))


@query("word_sheet")
def word_sheet(t: Tables):
    """One JSON sheet for each word: fits, peaks, a density of at most 800 points, moments."""
    s = words(t)
    rows = series.moments(s, "x").join(peaks.sheets(s), "mot")
    return rows.select("mot", F.to_json(F.struct("fits", "peaks", "density", "mean", "std", "var_mean", "skew", "kurt")).alias("sheet"))


# choice of peaks


def _candidates(t: Tables) -> DataFrame:
    """Peaks of the dense brand series by Poisson p-values: many, so that neighbours compete. Made once for a query."""
    return t.once("candidates", lambda: cut(peaks.daily_pvalues(t.series, "poisson", 1, 0.05).withColumn("surprise", F.round("surprise", 9))))


def _chosen(*plans: tuple[str, float, int]) -> str:
    """CTEs of the greedy choice by SQL: for each (name, threshold, reach) the tables name_pk, all peaks with their
    turn, and name, the positions that stay with their turns."""
    out = [f"q AS (SELECT *, row_number() OVER (PARTITION BY mot ORDER BY date) - 1 AS pos, 1e5 * x / nullif(n_tot, 0) AS f, round(-log10(greatest(p, 1e-300)), 9) AS surprise FROM ({_poisson('bser')}))"]
    for name, threshold, reach in plans:
        out += [
            f"{name}_pk AS (SELECT *, row_number() OVER (PARTITION BY mot ORDER BY surprise DESC, pos) AS rk FROM q WHERE p < 0.05 AND surprise >= {threshold})",
            f"""{name}_walk AS (SELECT mot, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT mot FROM {name}_pk)
                UNION ALL
                SELECT w.mot, w.i + 1, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - p.pos) < {reach})) > 0 THEN w.kept ELSE list_append(w.kept, p.pos) END
                FROM {name}_walk w JOIN {name}_pk p ON p.mot = w.mot AND p.rk = w.i + 1)""",
            f"{name} AS (SELECT k.mot, k.pos, p.rk FROM (SELECT mot, unnest(kept) AS pos FROM (SELECT mot, arg_max(kept, i) AS kept FROM {name}_walk GROUP BY mot)) k JOIN {name}_pk p ON p.mot = k.mot AND p.pos = k.pos)",
        ]
    return ", " + ",\n".join(out) + "\n"


def _chosen_sql(body: str, *plans: tuple[str, float, int]) -> str:
    return sql("\0", "bser").replace("\0", _chosen(*plans) + body).replace("WITH ", "WITH RECURSIVE ", 1)


_ABSORBED = "(SELECT mot, owner AS pos, count(*) AS absorbed FROM (SELECT p.mot, p.pos, arg_min(k.pos, k.rk) AS owner FROM a_pk p JOIN a k ON k.mot = p.mot AND abs(k.pos - p.pos) < 31 GROUP BY p.mot, p.pos) WHERE owner <> pos GROUP BY ALL)"


@query("nms", _chosen_sql("SELECT mot, pos FROM a", ("a", 0, 31)))
def nms(t: Tables):
    return peaks.nms(_candidates(t)).select("mot", "pos")


_KEPT = _chosen_sql(f"SELECT k.mot, p.date, k.pos, p.x, p.n_tot, round(p.f, 6) AS f, round(p.surprise, 6) AS surprise, coalesce(o.absorbed, 0) AS absorbed FROM a k JOIN a_pk p USING (mot, pos) LEFT JOIN {_ABSORBED} o USING (mot, pos)", ("a", 0, 31))


@query("nms_absorbed", _KEPT)
def nms_absorbed(t: Tables):
    """The kept peaks with what each took in."""
    return peaks.nms(_candidates(t)).select("mot", "date", "pos", "x", "n_tot", F.round("f", 6).alias("f"), F.round("surprise", 6).alias("surprise"), "absorbed")


@query("nms_rounds", _KEPT)
def nms_rounds(t: Tables):
    """The same for series of any length, in chunks of 512 days that wait for one another."""
    return peaks.nms_rounds(_candidates(t), chunk=512).select("mot", "date", "pos", "x", "n_tot", F.round("f", 6).alias("f"), F.round("surprise", 6).alias("surprise"), "absorbed")


@query("nms_crosscheck")
def nms_crosscheck(t: Tables):
    """Surprise has two decimals here, so that there are ties and stretches of one height, where the methods differ."""
    return peaks.crosscheck(_candidates(t).withColumn("surprise", F.round("surprise", 2)), 1.3)


_SLICE = "date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND mot = 'Brand#13'"


@query("nms_slice", _chosen_sql(f"SELECT date, round(f, 6) AS f, round(surprise, 6) AS surprise, 'all' AS stage FROM a_pk WHERE {_SLICE} UNION ALL SELECT date, round(f, 6), round(surprise, 6), 'kept' FROM a_pk JOIN a USING (mot, pos) WHERE {_SLICE}", ("a", 0, 31)))
def nms_slice(t: Tables):
    """One word and period before and after the choice."""
    stages = {"all": _candidates(t), "kept": peaks.nms(_candidates(t).where("mot = 'Brand#13'"))}
    part = lambda name: stages[name].where(_SLICE).select("date", F.round("f", 6).alias("f"), F.round("surprise", 6).alias("surprise"), F.lit(name).alias("stage"))
    return part("all").unionByName(part("kept"))


_GRID = [(threshold, half) for threshold in (1.3, 2.0, 3.0) for half in (7, 15)]
_FITS_IN = "(SELECT mot, max(pos) AS last FROM q GROUP BY mot)"


def _whole(kept: DataFrame, days: DataFrame, half: int) -> DataFrame:
    """Peaks whose window lies within the series."""
    return sized_join(kept, days, "mot").where((F.col("pos") - half >= 0) & (F.col("pos") + half < F.col("days")))


def _lengths(t: Tables) -> DataFrame:
    return t.once("lengths", lambda: cut(t.series.groupBy("mot").agg(F.count("*").alias("days"))))


@query("window_counts", _chosen_sql(" UNION ALL ".join(f"SELECT {threshold}::DOUBLE AS threshold, {half} AS half, count(*) AS windows, count(*) * count(*) AS cells FROM w{k} JOIN {_FITS_IN} USING (mot) WHERE pos - {half} >= 0 AND pos + {half} <= last" for k, (threshold, half) in enumerate(_GRID)), *((f"w{k}", threshold, 2 * half + 1) for k, (threshold, half) in enumerate(_GRID))))
def window_counts(t: Tables):
    """Windows, and cells of their kernel, by threshold and half width."""
    out = None
    for threshold, half in _GRID:
        whole = _whole(peaks.nms(_candidates(t).where(F.col("surprise") >= threshold), 2 * half + 1), _lengths(t), half)
        rows = whole.agg(F.count("*").alias("windows")).select(F.lit(threshold).alias("threshold"), F.lit(half).alias("half"), "windows", (F.col("windows") * F.col("windows")).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


# the chain of one configuration


def _grid(t: Tables) -> DataFrame:
    """(mot, pos, n_tot, f) of the whole series, made once for a query."""
    place = F.row_number().over(Window.partitionBy("mot").orderBy("date")) - 1
    return t.once("grid", lambda: cut(t.series.select("mot", "n_tot", series.freq(F.col("x"), F.col("n_tot")).alias("f"), place.alias("pos"))))


def chain(t: Tables, threshold: float, half: int, floor: int, log: bool = False) -> dict[str, DataFrame]:
    """Threshold -> choice -> windows -> thin days -> (log) -> z-scores, with every stage's rows. Made once for a query."""
    return t.once(("chain", threshold, half, floor, log), lambda: _chain(t, threshold, half, floor, log))


def _chain(t: Tables, threshold: float, half: int, floor: int, log: bool) -> dict[str, DataFrame]:
    above = _candidates(t).where(F.col("surprise") >= threshold)
    kept = cut(peaks.nms(above, 2 * half + 1).select("mot", "pos"))
    # each day of a window is looked up once, with its exposure
    days = kept.select("mot", F.col("pos").alias("centre"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("j")).withColumn("pos", F.col("centre") + F.col("j"))
    long = _whole_windows(days.join(_grid(t), ["mot", "pos"]).drop("pos"), half)
    clean = windows.interpolate_thin(long, floor)
    clean = clean.withColumn("f", F.log1p("f")) if log else clean
    arrays = cut(clean.groupBy("mot", "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda s: s.f).alias("w")))
    return {"above": above, "kept": kept, "windows": long.select("mot", "centre").distinct(), "clean": arrays, "z": windows.z_scores(arrays)}


def _whole_windows(long: DataFrame, half: int) -> DataFrame:
    """Windows that the edge of the grid doesn't cut."""
    return long.withColumn("n", F.count("*").over(Window.partitionBy("mot", "centre"))).where(F.col("n") == 2 * half + 1).drop("n")


def _stages(name: str, half: int, floor: int) -> dict[str, str]:
    """The stages of a chain over the positions that _chosen gives, as SQL; no window of a peak is flat."""
    whole = f"(SELECT k.mot, k.pos, p.n_tot FROM {name} k JOIN {name}_pk p USING (mot, pos) JOIN {_FITS_IN} USING (mot) WHERE pos - {half} >= 0 AND pos + {half} <= last)"
    full = f"(SELECT * FROM {whole} WHERE n_tot >= {floor})"
    return {"above": f"{name}_pk", "kept": name, "windows": whole, "clean": full, "z": full}


@query("stage_counts", _chosen_sql(" UNION ALL ".join(f"SELECT count(*) AS rows, count(DISTINCT mot) AS words, '{stage}' AS stage FROM {rows}" for stage, rows in _stages("a", 15, 12).items()), ("a", 1.3, 31)))
def stage_counts(t: Tables):
    out = None
    for name, df in chain(t, 1.3, 15, 12).items():
        rows = df.agg(F.count("*").alias("rows"), F.countDistinct("mot").alias("words")).withColumn("stage", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


CONFIGS = (("a", 1.3, 15, 12, False), ("b", 2.0, 15, 12, False), ("c", 1.3, 7, 12, False), ("d", 1.3, 7, 12, True))


def _row(t: Tables, name: str, threshold: float, half: int, floor: int, log: bool) -> DataFrame:
    z = chain(t, threshold, half, floor, log)["z"]
    d, key = 2 * half + 1, ["mot", "centre"]
    real = spectral.concentration(spectral.components(z, "w", []), [], d - 1)
    null = spectral.concentration(spectral.components(spectral.shuffled_columns(z, key, "w", 1), "w", []), [], d - 1).select(F.col("cum6").alias("null6"))
    turned = spectral.concentration(spectral.components(spectral.rotated(z, key, "w", 2), "w", []), [], d - 1).select(F.col("cum6").alias("turned6"))
    row = real.crossJoin(null).crossJoin(turned).crossJoin(z.agg(F.count("*").alias("windows"), F.countDistinct("mot").alias("words")))
    return row.withColumn("excess6", F.col("cum6") / F.col("null6")).withColumn("alignment6", F.col("cum6") / F.col("turned6")).withColumn("config", F.lit(name)).withColumn("width", F.lit(d))


@query("campaign_row")
def campaign_row(t: Tables):
    out = None
    for c in CONFIGS[:2]:
        out = _row(t, *c) if out is None else out.unionByName(_row(t, *c))
    return out


def check_configs(t: Tables, configs: tuple, expected: DataFrame) -> DataFrame:
    """expected(config, expected), the registry of window counts -> (config, got, expected, ok): what the chains give
    against it. A configuration that the registry doesn't know is not ok."""
    out = None
    for name, threshold, half, floor, log in configs:
        rows = chain(t, threshold, half, floor, log)["z"].agg(F.count("*").alias("got")).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return sized_join(out, expected, "config", "left").withColumn("ok", F.coalesce(F.col("got") == F.col("expected"), F.lit(False)))


@query("config_check", _chosen_sql(" UNION ALL ".join(f"SELECT '{name}' AS config, count(*) AS got, count(*) AS expected, true AS ok FROM {_stages(cte, half, 12)['z']}" for name, cte, half in (("a", "a", 15), ("b", "b", 15), ("c", "c", 7), ("d", "c", 7))), ("a", 1.3, 31), ("b", 2.0, 31), ("c", 1.3, 15)))
def config_check(t: Tables):
    """Windows that each chain gives, against a registry made from positions alone: kept peaks whose window lies within
    the grid and whose centre isn't thin. Windows that get lost, or come twice, on the way are not ok."""
    out = None
    for name, threshold, half, floor, _ in CONFIGS:
        kept = peaks.nms(_candidates(t).where(F.col("surprise") >= threshold), 2 * half + 1)
        rows = _whole(kept, _lengths(t), half).where(F.col("n_tot") >= floor).agg(F.count("*").alias("expected")).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return check_configs(t, CONFIGS, out)


@query("compare_configs")
def compare_configs(t: Tables):
    """The first components of several configurations side by side."""
    out = None
    for name, threshold, half, floor, log in CONFIGS:
        c = spectral.components(chain(t, threshold, half, floor, log)["z"], "w", []).where("rank <= 3").select(F.lit(name).alias("config"), "rank", "share", "component")
        out = c if out is None else out.unionByName(c)
    return out


def _z(t: Tables) -> DataFrame:
    return windows.z_scores(array_windows(t))


@query("pca_spectrum")
def pca_spectrum(t: Tables):
    return spectral.components(_z(t), "w", []).select("rank", F.round("share", 9).alias("share"), "component")


@query("pca_projections")
def pca_projections(t: Tables):
    z = cut(_z(t))
    return spectral.oriented(spectral.projections(z, "w", spectral.components(z, "w", []), 6)).select("mot", "centre", "proj")


@query("pca_metrics")
def pca_metrics(t: Tables):
    return spectral.concentration(spectral.components(_z(t), "w", []), [], 30)


@query("null_shuffle")
def null_shuffle(t: Tables):
    return spectral.components(spectral.shuffled_columns(_z(t), ["mot", "centre"], "w", 1), "w", []).select("rank", "share")


@query("null_rotation")
def null_rotation(t: Tables):
    return spectral.components(spectral.rotated(_z(t), ["mot", "centre"], "w", 2), "w", []).select("rank", "share")


@query("norm_compare")
def norm_compare(t: Tables):
    """Spectra of three normal forms on one rank."""
    col = windows.column_scores(long_windows(t)).groupBy("mot", "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda s: s.f).alias("w"))
    forms = {"z": _z(t), "minmax": windows.min_max(array_windows(t)), "column": col}
    out = None
    for name, df in forms.items():
        s = spectral.components(df, "w", []).select("rank", F.col("share").alias(name))
        out = s if out is None else out.join(s, "rank")
    return out


@query("archetypes")
def archetypes(t: Tables):
    """The three windows that lie best along each of the first six components."""
    p = pca_projections(t).select("mot", "centre", F.posexplode("proj").alias("k", "v"), F.sqrt(F.aggregate("proj", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    w = Window.partitionBy("k").orderBy(F.desc(F.abs(F.try_divide("v", "norm"))), "mot", "centre")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("k", "rank", "mot", "centre", F.try_divide("v", "norm").alias("cosine"))


@query("reconstruction")
def reconstruction(t: Tables):
    """Share of each window's energy that its first K components restore."""
    z = _z(t)
    p = spectral.projections(z, "w", spectral.components(z, "w", []), 31)
    total = F.aggregate("proj", F.lit(0.0), lambda s, x: s + x * x)
    part = lambda k: F.try_divide(F.aggregate(F.slice("proj", 1, k), F.lit(0.0), lambda s, x: s + x * x), total)
    return p.select("mot", "centre", *[part(k).alias(f"k{k}") for k in (1, 3, 6, 12)])


@query("event_plane")
def event_plane(t: Tables):
    """Place of each word's most surprising window on the first two components; the earliest of equals."""
    surprise = peaks.daily_pvalues(t.series, "poisson").select("mot", F.col("pos").alias("centre"), F.round("surprise", 9).alias("surprise"))
    p = pca_projections(t).join(surprise, ["mot", "centre"])
    best = p.groupBy("mot").agg(F.max_by(F.struct("centre", "proj", "surprise"), F.struct("surprise", -F.col("centre"))).alias("s"))
    return best.select("mot", "s.centre", "s.surprise", F.col("s.proj")[0].alias("c1"), F.col("s.proj")[1].alias("c2"))


# kernels


@query("gamma_median", "SELECT round(m, 6) AS median, round(1 / (2 * m), 8) AS gamma FROM (SELECT quantile_cont(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0.5) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 11)")
def gamma_median(t: Tables):
    return spectral.median_distance(t.raw("embeddings"), "vec_id", "embedding", 11).select(F.round("median", 6).alias("median"), F.round("gamma", 8).alias("gamma"))


@query("kernel_spectrum")
def kernel_spectrum(t: Tables):
    return spectral.kernel_spectra(t.raw("embeddings"), "embedding", [1 / 64])


#: fixed values: widths of the grid, as multiples of the median one
WIDTHS = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 10.0, 30.0)


@query("kernel_grid")
def kernel_grid(t: Tables):
    """Components for half and 90 % of the variance, by width around the one of the median distance."""
    vectors = t.raw("embeddings")
    # pairs as in gamma_median; without a pair, or where most are equal, there is no such width
    middle = spectral.median_distance(vectors, "vec_id", "embedding", 11).first()
    gammas = [middle.gamma * f for f in WIDTHS] if middle and middle.median else []
    spectra = spectral.kernel_spectra(vectors, "embedding", gammas, None)
    cum = spectra.withColumn("cum", F.sum("share").over(Window.partitionBy("gamma").orderBy("rank")))
    return cum.groupBy("gamma").agg(F.min(F.when(F.col("cum") >= 0.5, F.col("rank"))).alias("k50"), F.min(F.when(F.col("cum") >= 0.9, F.col("rank"))).alias("k90"), F.max("n").alias("n"))


@query("kernel_summary")
def kernel_summary(t: Tables):
    """One row for each number of components, one column for each width: the shares that they hold together."""
    spectra = spectral.kernel_spectra(t.raw("embeddings"), "embedding", [0.5 * f for f in (0.1, 0.3, 1.0, 3.0)], 10)
    cum = spectra.withColumn("cum", F.sum("share").over(Window.partitionBy("gamma").orderBy("rank")))
    return cum.where(F.col("rank").isin(1, 3, 6, 10)).groupBy("rank").pivot("gamma", [0.05, 0.15, 0.5, 1.5]).agg(F.round(F.first("cum"), 9))


@query("kernel_pitfall")
def kernel_pitfall(t: Tables):
    """Shares against the full trace and, wrongly, against the sum of the first 30 values."""
    s = spectral.kernel_spectra(t.raw("embeddings"), "embedding", [1 / 64], 30)
    return s.select("rank", "share", (F.col("share") / F.sum("share").over(Window.partitionBy("gamma"))).alias("share_of_kept"))


# correlations


@query("hier_clusters")
def hier_clusters(t: Tables):
    """Groups of words by average linkage, named by their first word."""
    p = _spearman(t).select("mot_i", "mot_j", F.abs("r").alias("s"))
    return corr.average_linkage(p, t.series.select("mot").distinct(), 0.97)


@query("mp_fit")
def mp_fit(t: Tables):
    """Noise band of the eigenvalues and the values over it."""
    found, words, days = corr.spectrum(_ranks(t), "avg_rank")
    n = len(words)
    _, ratio, low, high = corr.fit_noise(found.nodes, n / days, found.weights)
    rows = [(k + 1, float(v), float(low), float(high), float(n / ratio), bool(v > high)) for k, v in enumerate(found.values)]
    return t.rows(rows, "rank long, value double, low double, high double, days double, spike boolean")


def _denoised(t: Tables) -> DataFrame:
    return corr.denoised(_ranks(t), "avg_rank")


@query("corr_denoise")
def corr_denoise(t: Tables):
    return _denoised(t)


@query("denoise_shift")
def denoise_shift(t: Tables):
    """How far denoising moves a coefficient, by its size."""
    band = F.width_bucket(F.abs("r"), F.lit(0.0), F.lit(0.1), F.lit(5))
    shifts = cut(_denoised(t).select(band.alias("band"), F.abs(F.col("clean") - F.col("r")).alias("shift")))
    medians = quantiles.exact(shifts, ["band"], "shift", (0.5,)).select("band", F.col("v")[0].alias("median_shift"))
    return shifts.groupBy("band").agg(F.count("*").alias("pairs")).join(medians, "band")


@query("axis_words")
def axis_words(t: Tables):
    """The words with the largest and smallest loadings of the first eigenvectors."""
    found, words, _ = corr.spectrum(_ranks(t), "avg_rank", 8)
    vectors = found.vectors[:, :3]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    rows = []
    for k, axis in enumerate(vectors.T):
        top, low = (sorted(range(len(words)), key=lambda i: (sign * axis[i], words[i]))[:5] for sign in (-1, 1))  # noqa: B023
        rows += [(k + 1, words[i], float(axis[i]), "top" if i in top else "bottom") for i in dict.fromkeys(top + low)]
    return t.rows(rows, "axis long, mot string, loading double, side string")
