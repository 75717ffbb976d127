"""Principal components, kernels, null models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lanczos
from .lineage import cut
from .quantiles import exact


def _squared_distance(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Vectors of a block of a Gram matrix, about: a pair of blocks meets in one task.
KERNEL_BLOCK = 512
#: Rows of a pair of blocks that are given on at once, and blocks of a part, about: a task is handed the pairs of two parts.
ROWS_GIVEN, PART_BLOCKS = 64, 8


def _sides(spark, blocks: int) -> int:
    """Parts of the blocks: each two parts meet in one task."""
    return max(1, min(blocks, math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))), -(-blocks // PART_BLOCKS))


def _met(held: DataFrame) -> DataFrame:
    """Every two stored blocks p <= q of held(b, ...), with their columns as x_... and y_...

    Each task reads the two parts of the blocks that meet in it where they lie: nothing is copied for the pairs or shuffled.
    """
    side = lambda name, mark: held.select(F.col("b").alias(name), *[F.col(c).alias(f"{mark}_{c}") for c in held.columns if c != "b"])
    return side("p", "x").join(side("q", "y").hint("shuffle_replicate_nl"), F.col("p") <= F.col("q"))


def rbf_gram(df: DataFrame, key: str, vector: str, gamma: float) -> DataFrame:
    """(i, j, k), i <= j: the kernel of all vectors, in pairs of blocks. The result itself has a row for each pair.

    Blocks are ranges of the key, so a pair of blocks gives runs of one ``i`` with ``j`` ascending, which take next to no
    bytes in Parquet. A task's first pair of blocks comes in order of ``k``: Parquet's writer keeps a dictionary only where
    the first page repeats its values, and rounded values then take some 17 bits in place of 64.
    """
    v = df.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("a")).where("i is not null")
    blocks = max(1, -(-v.count() // KERNEL_BLOCK))
    kind = v.schema["i"].dataType.simpleString()

    def dense(batches):
        of = [df for df in batches if len(df)]
        if of:
            df = pd.concat(of).sort_values("i")
            width = max((len(a) for a in df["a"] if a is not None), default=0)
            # a null vector has no distance: NaN here, null in the result
            z = np.array([np.full(width, np.nan) if a is None else a for a in df["a"]], float)
            yield pd.DataFrame({"b": [TaskContext.get().partitionId()], "i": [df["i"].tolist()], "z": [z.tobytes()]})

    def vectors(z: bytes, n: int, width: int) -> np.ndarray:
        return np.frombuffer(z).reshape(n, -1) if z else np.full((n, width), np.nan)

    def met(r):
        x, y = np.asarray(r.x_i), np.asarray(r.y_i)
        width = max(len(r.x_z) // len(x), len(r.y_z) // len(y)) // 8
        left, right = vectors(r.x_z, len(x), width), vectors(r.y_z, len(y), width)
        for at in range(0, len(x), ROWS_GIVEN):
            few = x[at : at + ROWS_GIVEN]
            k = np.stack([np.exp(-gamma * ((right - a) ** 2).sum(1)) for a in left[at : at + ROWS_GIVEN]]).ravel()
            i, j = np.repeat(few, len(y)), np.tile(y, len(few))
            ok = i <= j if r.p == r.q else slice(None)
            yield pd.DataFrame({"i": i[ok], "j": j[ok], "k": k[ok]})

    def run(batches):
        pairs = (met(r) for batch in batches for r in batch.itertuples(index=False))
        for first in pairs:
            yield pd.concat(first).sort_values("k")
            break
        for pair in pairs:
            yield from pair

    held = v.repartitionByRange(blocks, "i").mapInPandas(dense, f"b long, i array<{kind}>, z binary")
    return _met(cut(held.repartition(_sides(df.sparkSession, blocks), "b"))).mapInPandas(run, f"i {kind}, j {kind}, k double")


def median_distance(df: DataFrame, key: str, vector: str, shift: int) -> DataFrame:
    """Median squared distance over the pairs (k, k + shift), and gamma = 1 / (2 median)."""
    v = df.select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("a"))
    pairs = v.join(v.select((F.col("i") - shift).alias("i"), F.col("a").alias("b")), "i")
    return exact(pairs, [], _squared_distance("a", "b"), (0.5,)).select(F.col("v")[0].alias("median")).withColumn("gamma", 1 / (2 * F.col("median")))


# A matrix of windows has D columns (tens to a hundred): its D x D moments are summed by Spark, and only they reach one
# task. Kernel matrices are n x n by nature and never held.


def covariance(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys..., n, mean, cov): moments of a vector column, summed by tasks before one row for each task is shuffled."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def part(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for key, g in b.groupby(keys, dropna=False, sort=False) if keys else [((), b)]:
                m = np.stack(g[vector].to_numpy()).astype(float)
                h = held.setdefault(tuple(key), [0, 0.0, 0.0])
                h[0] += len(m)
                h[1] = h[1] + m.sum(0)
                h[2] = h[2] + m.T @ m
        yield pd.DataFrame([(*k, n, s.tolist(), q.ravel().tolist()) for k, (n, s, q) in held.items()], columns=[*keys, "n", "s", "q"])

    sums = df.select(*keys, vector).mapInPandas(part, f"{fields}{', ' if keys else ''}n long, s array<double>, q array<double>")

    def total(key, g: pd.DataFrame) -> pd.DataFrame:
        n, s, q = int(g["n"].sum()), sum(np.array(x) for x in g["s"]), sum(np.array(x) for x in g["q"])
        mean = s / n
        cov = q.reshape(len(s), len(s)) - n * np.outer(mean, mean)
        return pd.DataFrame([(*key, n, mean.tolist(), cov.ravel().tolist())], columns=[*keys, "n", "mean", "cov"])

    grouped = sums.groupBy(*keys) if keys else sums.groupBy(F.lit(0).alias("all"))
    if not keys:
        inner = total
        total = lambda key, g: inner((), g)
    return grouped.applyInPandas(total, f"{fields}{', ' if keys else ''}n long, mean array<double>, cov array<double>")


def decomposed(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, shares), largest first; a component's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return vectors * np.where(signs == 0, 1, signs)[:, None], values / max(values.sum(), 1e-300)


def components(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys..., rank, share, component, mean): principal components of a vector column."""
    moments = covariance(df, vector, keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                d = len(r.mean)
                comp, share = decomposed(np.array(r.cov).reshape(d, d))
                rows += [(*[getattr(r, k) for k in keys], i + 1, float(share[i]), comp[i].tolist(), list(r.mean)) for i in range(d)]
            yield pd.DataFrame(rows, columns=[*keys, "rank", "share", "component", "mean"])

    return moments.mapInPandas(run, f"{fields}{', ' if keys else ''}rank long, share double, component array<double>, mean array<double>")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def projections(df: DataFrame, vector: str, comps: DataFrame, k: int) -> DataFrame:
    """df with ``proj``: coordinates of the centred vectors on the first k components (one small row, broadcast)."""
    few = comps.where(F.col("rank") <= k).groupBy(F.lit(1).alias("one")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "component"))), lambda s: s.component).alias("comps"), F.first("mean").alias("mean")).drop("one")
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.col("mean"), lambda x, m: x - m)
    return df.crossJoin(F.broadcast(few)).withColumn("centred", centred).withColumn("proj", F.transform("comps", lambda c: _dot(c, F.col("centred")))).drop("comps", "mean", "centred")


def oriented(projected: DataFrame) -> DataFrame:
    """Turns each component so that the cubes of its projections have a sum of 0 or more: its long tail points upwards."""
    signs = projected.select(F.posexplode("proj").alias("k", "v")).groupBy("k").agg(F.when(F.sum(F.pow("v", F.lit(3.0))) < 0, -1.0).otherwise(1.0).alias("sign"))
    every = signs.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sign"))), lambda s: s.sign).alias("signs"))
    return projected.crossJoin(F.broadcast(every)).withColumn("proj", F.zip_with("proj", "signs", lambda v, s: v * s)).drop("signs")


def concentration(spectrum: DataFrame, keys: list[str], rank_of: int) -> DataFrame:
    """spectrum(keys..., rank, share) -> k50, k50 over rank, effective rank, shares of 3, 6, 10 components, gain of 6."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("rank")
    cum = spectrum.withColumn("cum", F.sum("share").over(w))
    upto = lambda k: F.max(F.when(F.col("rank") <= min(k, rank_of), F.col("cum")))
    out = cum.groupBy(*keys).agg(F.min(F.when(F.col("cum") >= 0.5, F.col("rank"))).alias("k50"), (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_rank"), *[upto(k).alias(f"cum{k}") for k in (3, 6, 10)])
    return out.withColumn("k50_share", F.col("k50") / rank_of).withColumn("gain6", F.col("cum6") / (min(6, rank_of) / rank_of))


def shuffled_columns(df: DataFrame, key: list[str], vector: str, seed: int) -> DataFrame:
    """Null model: each place of the vectors permuted on its own, by a seeded hash order; keys keep their rows.

    Two orders of the rows are matched for each place: by key and by hash. Ranks are taken inside hash ranges and
    shifted by the sizes of the ranges before, so no task sorts a whole place.
    """
    from pyspark.sql import Window

    long = df.select(*key, F.posexplode(vector).alias("j", "v")).withColumn("by_key", F.xxhash64(*key, F.lit(seed))).withColumn("by_hash", F.xxhash64(*key, "j", F.lit(seed + 1)))

    def ranked(column: str) -> DataFrame:
        part = F.shiftright(F.col(column), 56)
        rows = long.withColumn("part", part)
        sizes = rows.groupBy("j", "part").agg(F.count("*").alias("size"))
        before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("j").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
        rank = F.row_number().over(Window.partitionBy("j", "part").orderBy(column, *key))
        return rows.withColumn("r", rank).join(F.broadcast(before), ["j", "part"]).withColumn("r", F.col("r") + F.col("before"))

    rows, values = ranked("by_key").select(*key, "j", "r"), ranked("by_hash").select("j", "r", "v")
    back = rows.join(values, ["j", "r"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s.v).alias(vector))
    return back


def rotated(df: DataFrame, key: list[str], vector: str, seed: int) -> DataFrame:
    """Null model: each vector turned by a seeded offset of its own."""
    from .windows import roll

    return df.withColumn(vector, roll(F.col(vector), F.pmod(F.xxhash64(*key, F.lit(seed)), F.size(vector))))


def _blocks(df: DataFrame, vector: str) -> tuple[DataFrame, int, list[int]]:
    """Vectors in blocks (b, z), stored; the number of vectors, and the blocks' sizes.

    Vectors are dealt into blocks by hash of their components; a task later holds two blocks and nothing else.
    """
    v = df.select(F.col(vector).cast("array<double>").alias("z"))
    n = v.count()
    blocks = max(1, -(-n // SPECTRUM_BLOCK))

    def dense(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [key[0]], "size": [len(pdf)], "z": [np.stack(pdf["z"].to_numpy()).astype(float).tobytes()]})

    one = v.withColumn("b", F.pmod(F.xxhash64("z", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    held = cut(one.groupBy("b").applyInPandas(dense, "b int, size long, z binary").repartition(_sides(df.sparkSession, blocks)))
    sizes = {r.b: r.size for r in held.select("b", "size").collect()}
    # a block that has no vectors meets none
    return held.select("b", "z"), n, [sizes.get(b, 0) for b in range(blocks)]


#: Rows of a kernel of two blocks that are made at once, in a core's cache.
KERNEL_ROWS = 64


def _kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    left, right, twice = -gamma * (x**2).sum(1), -gamma * (y**2).sum(1), 2 * gamma * x
    for at in range(0, len(x), KERNEL_ROWS):
        few = out[at : at + KERNEL_ROWS]
        np.matmul(twice[at : at + KERNEL_ROWS], y.T, out=few)
        few += left[at : at + KERNEL_ROWS, None]
        few += right
        np.exp(np.minimum(few, 0, out=few), out=few)
    return out


def _kernel_product(blocks: DataFrame, sizes: list[int], gamma: float):
    """Multiplies the doubly centred kernel with a panel: tasks make the kernel of two blocks anew, and drop it.

    What a task's pairs give a block is summed before it is shuffled.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    n = int(ends[-1])

    def uncentred(panel: np.ndarray) -> np.ndarray:
        held, width = blocks.sparkSession.sparkContext.broadcast(panel), panel.shape[1]

        def run(batches):
            v, sums = held.value, {}
            for b in batches:
                for r in b.itertuples(index=False):
                    x, y = (np.frombuffer(z).reshape(sizes[k], -1) for k, z in ((r.p, r.x_z), (r.q, r.y_z)))
                    k = _kernel(x, y, gamma)
                    sums[r.p] = sums.get(r.p, 0) + k @ v[ends[r.q] : ends[r.q + 1]]
                    if r.p != r.q:
                        sums[r.q] = sums.get(r.q, 0) + k.T @ v[ends[r.p] : ends[r.p + 1]]
            for b, part in sums.items():
                yield pd.DataFrame({"b": [b], "part": [part.tobytes()]})

        def total(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"b": [key[0]], "part": [sum(np.frombuffer(x) for x in pdf["part"]).tobytes()]})

        out = np.zeros((n, width))
        for r in _met(blocks).mapInPandas(run, "b int, part binary").groupBy("b").applyInPandas(total, "b int, part binary").collect():
            out[ends[r.b] : ends[r.b + 1]] = np.frombuffer(r.part).reshape(-1, width)
        held.destroy()  # the driver's own copy goes too
        return out

    total: list[float] = []

    def product(panel: np.ndarray) -> np.ndarray:
        panel = panel - panel.mean(0)
        if total:
            y = uncentred(panel)
        else:  # the kernel's sum comes with the first product
            y = uncentred(np.hstack([panel, np.ones((n, 1))]))
            total.append(y[:, -1].sum())
            y = y[:, :-1]
        y -= y.mean(0)
        return y

    return product, lambda: n - total[0] / n


#: Numbers of a start of the kernel's leading vectors, at most.
START = 1 << 21


def _start(blocks: DataFrame, sizes: list[int]) -> np.ndarray:
    """The vectors' coordinates on their first principal directions, as many as START allows; vectors stay with Spark."""
    n = sum(sizes)

    def moments(batches):
        found = 0
        for b in batches:
            for r in b.itertuples(index=False):
                z = np.frombuffer(r.z).reshape(sizes[r.b], -1)
                z = np.hstack([z, np.ones((len(z), 1))])
                found = found + z.T @ z
        if np.ndim(found):
            yield pd.DataFrame({"m": [found.tobytes()]})

    sums = sum(np.frombuffer(r.m) for r in blocks.mapInPandas(moments, "m binary").toLocalIterator())
    width = math.isqrt(len(sums)) - 1
    sums = sums.reshape(width + 1, -1)
    mean = sums[-1, :-1] / n
    turn = np.linalg.eigh(sums[:-1, :-1] - n * np.outer(mean, mean))[1][:, ::-1][:, : START // n]

    def placed(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"b": [r.b], "z": [((np.frombuffer(r.z).reshape(sizes[r.b], -1) - mean) @ turn).tobytes()]})

    ends, out = np.concatenate([[0], np.cumsum(sizes)]), np.zeros((n, turn.shape[1]))
    for r in blocks.mapInPandas(placed, "b int, z binary").toLocalIterator():
        out[ends[r.b] : ends[r.b + 1]] = np.frombuffer(r.z).reshape(sizes[r.b], -1)
    return out


#: Vectors of a block of a kernel whose spectrum is taken, about.
SPECTRUM_BLOCK = 1024


def kernel_spectra(df: DataFrame, vector: str, gammas: list[float], keep: int | None = 30, panel: int = lanczos.PANEL) -> DataFrame:
    """(gamma, rank, share, n): spectrum of the doubly centred RBF kernel; shares are of trace(K) - sum(K) / n.

    The kernel is never held: block Lanczos multiplies it with panels, one Spark job a step over pairs of blocks of
    vectors. ``keep`` None wants all values; where the vectors are too many for the whole spectrum, the values that are
    taken then come to a basis of ``lanczos.MAX_BASIS`` numbers, or an error says that they don't.
    """
    blocks, n, sizes = _blocks(df, vector)
    rows = []
    # the leading vectors of a wide kernel are nearly linear in the vectors
    steps = keep is not None and min(n, max(lanczos.NARROW, panel // max(n, 1))) < n <= START
    start = _start(blocks, sizes) if steps else None
    for g in gammas if n else []:
        product, trace = _kernel_product(blocks, sizes, g)
        found = lanczos.spectrum(product, n, n if keep is None else min(keep, n), panel=panel, restart=keep is not None, start=start)
        rows += [(float(g), k + 1, float(v / trace()), n) for k, v in enumerate(found.values[:keep])]
    return df.sparkSession.createDataFrame(rows, "gamma double, rank long, share double, n long")
