"""Correlations of words, term weights, clusters and the noise of correlation matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lanczos
from .lineage import cut, sized_join


def tfidf(counts: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """counts(id, gram, n) -> (id, gram, tfidf): smoothed idf, rows of length 1."""
    # both sums read n, so that they share the shuffle of the counts
    size = counts.agg(F.countDistinct(F.when(F.col("n") > 0, F.col("id"))).alias("size"))
    df = counts.groupBy("gram").agg(F.sum((F.col("n") > 0).cast("long")).alias("df")).crossJoin(F.broadcast(size)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("size")))
    weight = F.col("n") * (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1)
    rows = counts.join(df, "gram").select("id", "gram", weight.alias("w"))
    return rows.select("id", "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("tfidf"))


def residuals(series: DataFrame, clip: float | None = 8.0) -> DataFrame:
    """series(mot, date, x, n_tot) with z, the Poisson residual at the word's mean rate, cut to +-clip."""
    w = Window.partitionBy("mot")
    mu = F.sum("x").over(w) / F.sum("n_tot").over(w)
    z = (F.col("x") - F.col("mu") * F.col("n_tot")) / F.sqrt(F.nullif(F.col("mu") * F.col("n_tot"), F.lit(0.0)))
    z = z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return series.withColumn("mu", mu).withColumn("z", z)


#: Words and days of a tile, about; 8 bytes a cell.
TILE_WORDS, TILE_DAYS = 256, 4096


def _tiles(long: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(b, part, mots, days, cells), stored: words by days, each word without its mean; absent days are NaN.

    Words are dealt into blocks by hash, days into parts by order; a word's values in a part of the days lie in one tile.
    """
    word = Window.partitionBy("mot")
    centred = long.select("mot", "date", (F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(word)).alias("v"))
    days = cut(centred.select("date").distinct())
    blocks = max(1, -(-centred.select("mot").distinct().count() // TILE_WORDS))
    parts = max(1, -(-days.count() // TILE_DAYS))
    dealt = centred.withColumn("b", F.pmod(F.xxhash64("mot"), F.lit(blocks)).cast("int")).withColumn("part", F.pmod(F.xxhash64("date"), F.lit(parts)).cast("int"))

    def tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.pivot_table(index="mot", columns="date", values="v", aggfunc="first", dropna=False).sort_index()
        dates = pd.to_datetime(cells.columns).astype("datetime64[s]").astype(np.int64) if not pd.api.types.is_numeric_dtype(cells.columns) else cells.columns
        return pd.DataFrame({"b": [key[0]], "part": [key[1]], "mots": [list(cells.index)], "days": [np.asarray(dates, np.int64).tobytes()], "cells": [cells.to_numpy(float).tobytes()]})

    return cut(dealt.groupBy("b", "part").applyInPandas(tile, "b int, part int, mots array<string>, days binary, cells binary")), blocks


def _sums(tiles: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """What ``run`` (words, words, sums of products over common days) gives for every two blocks of words.

    A tile goes to one task for each block: words x days x blocks cells are shuffled, not words x words x days rows.
    """
    met = tiles.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("p", F.least("b", "o")).withColumn("q", F.greatest("b", "o"))

    def load(r):
        cells = np.frombuffer(r.cells).reshape(len(r.mots), -1)
        return list(r.mots), np.frombuffer(r.days, np.int64), cells

    def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = ({r.part: load(r) for r in pdf[pdf["b"] == k].itertuples()} for k in key)
        names = [sorted({m for mots, _, _ in side.values() for m in mots}) for side in (left, right)]
        place = [{m: k for k, m in enumerate(n)} for n in names]
        total = np.zeros((6, len(names[0]), len(names[1])))
        for part in left.keys() & right.keys():
            (m1, d1, a), (m2, d2, b) = left[part], right[part]
            _, i, j = np.intersect1d(d1, d2, return_indices=True)
            a, b = a[:, i], b[:, j]
            one, two = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
            a, b = np.nan_to_num(a), np.nan_to_num(b)
            at = np.ix_([place[0][m] for m in m1], [place[1][m] for m in m2])
            for k, (x, y) in enumerate(((one, two), (a, two), (one, b), (a * a, two), (one, b * b), (a, b))):
                total[k][at] += x @ y.T
        return run(names, total, key[0] == key[1])

    return met.groupBy("p", "q").applyInPandas(product, schema)


def _pearson(s: np.ndarray) -> np.ndarray:
    """From (n, sum a, sum b, sum aa, sum bb, sum ab); NaN where a word doesn't vary."""
    n, a, b, aa, bb, ab = s
    with np.errstate(invalid="ignore", divide="ignore"):
        va, vb = aa - a * a / n, bb - b * b / n
        r = (ab - a * b / n) / np.sqrt(va * vb)
    return np.where((va > 1e-12 * np.maximum(aa, 1e-300)) & (vb > 1e-12 * np.maximum(bb, 1e-300)), np.clip(r, -1, 1), np.nan)


def pairs(long: DataFrame, value: str) -> DataFrame:
    """(mot_i, mot_j, r), mot_i < mot_j: Pearson correlation of all words over their common days; null where one is flat.

    Tiles of words by days are multiplied in tasks; the result has a row for each pair of words that have a common day.
    """

    def run(names, s, same: bool) -> pd.DataFrame:
        r = _pearson(s)
        i, j = np.nonzero((s[0] > 0) & (np.array(names[0])[:, None] < np.array(names[1])[None] if same else True))
        x, y = np.array(names[0], object)[i], np.array(names[1], object)[j]
        return pd.DataFrame({"mot_i": np.where(x < y, x, y), "mot_j": np.where(x < y, y, x), "r": r[i, j]})

    out = _sums(*_tiles(long, value), run, "mot_i string, mot_j string, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def neighbours(long: DataFrame, value: str, k: int) -> DataFrame:
    """(mot, other, r, rank): the k words of the greatest correlation (to 9 places; ties by name) of each word.

    A task passes on the first k and what ties with them in its two blocks, so no row for each pair is made.
    """

    def best(words, others, r, ok) -> list:
        rows = []
        for i, w in enumerate(words):
            at = np.flatnonzero(ok[i] & ~np.isnan(r[i]))
            if len(at) > k:
                least = np.partition(r[i][at], len(at) - k)[len(at) - k]
                at = at[r[i][at] >= least - 1e-8]
            rows += [(w, others[j], float(r[i, j])) for j in at]
        return rows

    def run(names, s, same: bool) -> pd.DataFrame:
        r, ok = _pearson(s), s[0] > 0
        if same:
            ok = ok & ~np.eye(len(names[0]), dtype=bool)
        rows = best(names[0], names[1], r, ok) + ([] if same else best(names[1], names[0], r.T, ok.T))
        return pd.DataFrame(rows, columns=["mot", "other", "r"])

    few = _sums(*_tiles(long, value), run, "mot string, other string, r double")
    order = Window.partitionBy("mot").orderBy(F.desc(F.round("r", 9)), "other")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def standardised(long: DataFrame, value: str) -> tuple[DataFrame, list[str], int]:
    """(part, cells), stored: days by words, each word with mean 0 and length 1; the words, and the number of days.

    A cell that is absent is the word's mean. A word that is flat is left out, as nothing correlates with it. The words
    go to the driver, as the rows of the vectors that it holds anyway (``lanczos``).
    """
    word = Window.partitionBy("mot")
    v = F.col(value).cast("double")
    centred = long.select("mot", "date", (v - F.avg(v).over(word)).alias("v"))
    unit = centred.withColumn("v", F.try_divide("v", F.sqrt(F.sum(F.col("v") * F.col("v")).over(word)))).where("v is not null")
    unit = cut(unit)
    words = [r.mot for r in unit.select("mot").distinct().orderBy("mot").collect()]
    days = long.select("date").distinct().count()
    at = unit.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    per = max(1, lanczos.PANEL // max(len(words), 1))
    dealt = unit.withColumn("part", F.pmod(F.xxhash64("date"), F.lit(max(1, -(-days // per)))))

    def dense(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((pdf["date"].nunique(), len(at.value)))
        cells[pd.factorize(pdf["date"])[0], pdf["mot"].map(at.value).to_numpy()] = pdf["v"]
        return pd.DataFrame({"part": [key[0]], "cells": [cells.tobytes()]})

    return cut(dealt.groupBy("part").applyInPandas(dense, "part long, cells binary")), words, days


def spectrum(long: DataFrame, value: str, keep: int = 64, panel: int = lanczos.PANEL) -> tuple[lanczos.Spectrum, list[str], int]:
    """Values and vectors of the correlation matrix of all words, which is never held; the words, and the days.

    Z'Z of the standardised days x words is multiplied with panels, a Spark job a step: tasks multiply their days, and
    their sums come back. All values where the words are few, else the ``keep`` largest and the density of the rest.
    """
    cells, words, days = standardised(long, value)
    n = len(words)

    def product(panel: np.ndarray) -> np.ndarray:
        held = cells.sparkSession.sparkContext.broadcast(panel)

        def run(batches):
            out = None
            for b in batches:
                for c in b["cells"]:
                    z = np.frombuffer(c).reshape(-1, n)
                    y = z.T @ (z @ held.value)
                    out = y if out is None else out + y
            if out is not None:
                for at in range(0, n, 1 << 14):
                    yield pd.DataFrame({"at": [at], "part": [out[at : at + (1 << 14)].tobytes()]})

        def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [key[0]], "part": [sum(np.frombuffer(x) for x in pdf["part"]).tobytes()]})

        out = np.zeros((n, panel.shape[1]))
        for r in cells.mapInPandas(run, "at long, part binary").groupBy("at").applyInPandas(total, "at long, part binary").collect():
            some = np.frombuffer(r.part).reshape(-1, panel.shape[1])
            out[r.at : r.at + len(some)] = some
        held.unpersist()
        return out

    return lanczos.spectrum(product, n, min(keep, n), panel=panel), words, days


def average_linkage(pairs: DataFrame, words: DataFrame, most: float) -> DataFrame:
    """pairs(mot_i, mot_j, s), words(mot) -> (mot, cluster, size): average linkage of the distances 1 - s.

    Groups join while their mean distance is at most ``most`` (below 1: a pair that is absent has s = 0). Each round
    joins all groups that are each other's nearest: a joined group is never nearer to a third than its parts were, so
    the order doesn't change the groups. Sums of s over the pairs of two groups are kept; ties go to the smaller names.
    """
    groups = cut(words.select("mot", F.col("mot").alias("g")))
    sums = cut(pairs.select(F.least("mot_i", "mot_j").alias("a"), F.greatest("mot_i", "mot_j").alias("b"), "s").where("a < b and s <> 0"))
    while True:
        sizes = groups.groupBy("g").agg(F.count("*").alias("size"))
        one, two = (sizes.select(F.col("g").alias(c), F.col("size").alias(f"n{c}")) for c in ("a", "b"))
        near = sums.join(one, "a").join(two, "b").withColumn("d", 1 - F.col("s") / (F.col("na") * F.col("nb"))).where(F.col("d") <= most)
        both = near.select(F.col("a").alias("g"), "d", "a", "b").unionByName(near.select(F.col("b").alias("g"), "d", "a", "b"))
        nearest = both.groupBy("g").agg(F.min(F.struct("d", "a", "b")).alias("m"))
        joined = cut(nearest.groupBy("m.a", "m.b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b"))
        if joined.limit(1).count() == 0:
            of = groups.groupBy("g").agg(F.count("*").alias("size"))
            return groups.join(of, "g").select("mot", F.col("g").alias("cluster"), "size")
        # a group is in one pair at most; the smaller name stays
        into = joined.select(F.col("b").alias("g"), F.col("a").alias("into"))
        groups = cut(groups.join(into, "g", "left").select("mot", F.coalesce("into", "g").alias("g")))
        for c in ("a", "b"):
            sums = sums.join(into.withColumnsRenamed({"g": c}), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        sums = cut(sums.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))


#: Bins of the histogram of the bulk, rounds of its fit, bounds of (variance, ratio).
BINS, ROUNDS, BOUNDS = 60, 15, ((0.05, 3.0), (1e-3, 0.999))


def noise_edges(s2: float, q: float) -> tuple[float, float]:
    """Where the Marchenko-Pastur law of variance s2 and ratio q (words / days) begins and ends."""
    root = np.sqrt(q)
    return s2 * (1 - root) ** 2, s2 * (1 + root) ** 2


def noise_density(x: np.ndarray, s2, q) -> np.ndarray:
    """The Marchenko-Pastur density at x > 0, 0 outside its edges; s2 and q may be arrays that broadcast with x."""
    low, high = noise_edges(s2, q)
    return np.sqrt(np.maximum((high - x) * (x - low), 0)) / (2 * np.pi * q * s2 * x)


def _nearest_density(x: np.ndarray, seen: np.ndarray, s2: float, q: float) -> tuple[float, float]:
    """(s2, q) of least squares from the seen density: a grid around the last answer, closer and closer."""
    reach = np.array([0.5, 0.5])
    for _ in range(24):
        grids = [np.clip(centre * np.exp(np.linspace(-r, r, 9)), *bounds) for centre, r, bounds in zip((s2, q), reach, BOUNDS, strict=True)]
        loss = ((noise_density(x, grids[0][:, None, None], grids[1][None, :, None]) - seen) ** 2).sum(axis=-1)
        i, j = np.unravel_index(np.argmin(loss), loss.shape)
        s2, q = float(grids[0][i]), float(grids[1][j])
        # the grid closes in unless the best lies at its border
        reach = np.where([0 < i < 8, 0 < j < 8], reach * 0.6, reach)
    return s2, q


def fit_noise(values: np.ndarray, q: float, weights: np.ndarray | None = None) -> tuple[float, float, float, float]:
    """(variance, ratio, lower edge, upper edge) of the Marchenko-Pastur law that is nearest to the bulk's histogram.

    ``q``: words / days, where the fit begins. Each round takes the eigenvalues up to the last upper edge as bulk.
    Where dependent days carry less than their number, the fitted ratio is larger than ``q``. ``weights``: how much of
    the density lies at each value, where not all are known.
    """
    weights = np.ones(len(values)) if weights is None else weights
    s2 = 1.0
    for _ in range(ROUNDS):
        end = noise_edges(s2, q)[1]
        bulk, there = values[values <= end], weights[values <= end]
        if not len(bulk):
            break
        counts, ends = np.histogram(bulk, bins=BINS, range=(0, end), weights=there)
        width = end / BINS
        s2, q = _nearest_density(ends[:-1] + width / 2, counts / (there.sum() * width), s2, q)
    return s2, q, *noise_edges(s2, q)


def spikes(found: lanczos.Spectrum, days: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values over the noise, their vectors, the mean of the others) of a correlation matrix."""
    n = len(found.vectors)
    over = found.values > fit_noise(found.nodes, n / days, found.weights)[3]
    # the trace is n
    return found.values[over], found.vectors[:, over], (n - found.values[over].sum()) / max(1, n - over.sum())


def denoised(long: DataFrame, value: str, keep: int = 64) -> DataFrame:
    """(mot_i, mot_j, r, clean): correlations, and those of the matrix whose noise values are replaced by their mean.

    Scaled back to a unit diagonal. Words that are flat have no correlations.
    """
    found, words, days = spectrum(long, value, keep)
    values, vectors, rest = spikes(found, days)
    rows = vectors * np.sqrt(np.maximum(values - rest, 0))
    rows = rows / np.sqrt(np.maximum((rows**2).sum(1) + rest, 1e-12))[:, None]
    of = cut(long.sparkSession.createDataFrame([(w, x.tolist()) for w, x in zip(words, rows, strict=True)], "mot string, x array<double>"))
    both = pairs(long, value).where("r is not null")
    for c, x in (("mot_i", "x"), ("mot_j", "y")):
        both = sized_join(both, of.select(F.col("mot").alias(c), F.col("x").alias(x)), c)
    clean = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.select("mot_i", "mot_j", "r", clean.alias("clean"))
