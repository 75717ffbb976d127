"""Centroid clustering in whole numbers, with annulus search for the nearest centroid.

Centroids are sorted by norm. The distance ``u`` of a vector to any one centroid bounds its distance to the nearest
one from above, and a centroid within ``u`` has a norm within ``u`` of the vector's (triangle inequality). So binary
search finds the run of centroids whose norms lie in that annulus, and only these are compared, in whole numbers.

Each round is one pass over the stored vectors: tasks assign theirs and pass on one row for each cluster with sums
and a count; what comes back is one row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

SIZE, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
#: A component is floor(SCALE * x).
SCALE = 1024
#: Components up to this have squared distances below 2 ** 62; vectors beyond it can't have a distance that is a long.
LARGEST = 1 << 27
#: Vectors that a task compares at once.
ROWS_AT_ONCE = 8192
#: Annuli are wider by this share of the norms in them, far more than what floating point numbers round.
SLACK = 1e-9


class Annuli:
    """Centroids in order of norm; ties and equal centroids keep their numbers."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def bounds(self, norms: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run [low, high) of centroids whose norms are within ``upper`` of a vector's norm."""
        slack = SLACK * (norms + self.norms[-1] + 1)
        return np.searchsorted(self.norms, norms - upper - slack, "left"), np.searchsorted(self.norms, norms + upper + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of whole-number vectors, and the number of comparisons made."""
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        # the centroid of the nearest norm gives the upper bound
        after = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        probe = np.where(np.abs(self.norms[before] - norms) <= np.abs(self.norms[after] - norms), before, after)
        best = ((x - self.centroids[probe]) ** 2).sum(1)
        cluster, compared = self.number[probe], len(x)
        low, high = self.bounds(norms, np.sqrt(best.astype(np.float64)))
        for k in range(len(self.norms)):
            at = np.flatnonzero((low <= k) & (k < high) & (probe != k))
            if not len(at):
                continue
            compared += len(at)
            far, number = ((x[at] - self.centroids[k]) ** 2).sum(1), self.number[k]
            better = (far < best[at]) | ((far == best[at]) & (number < cluster[at]))
            best[at[better]], cluster[at[better]] = far[better], number
        return cluster, best, compared


def whole(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, v array<int>): the rows whose vectors are whole, in whole numbers."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    # a null makes forall null; floor of what isn't finite says nothing, so the parts are looked at first
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * SCALE <= LARGEST - 1))
    kept = vectors.where((F.size("embedding") == size) & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", x.cast("array<int>").alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(centroids: np.ndarray):
    """Of each cluster that a task meets: the vectors' sum and their number."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, sums, counts = Annuli(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches, size):
            cluster, _, _ = annuli.nearest(x)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(cluster, minlength=len(centroids))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for part, x in _blocks(batches, centroids.shape[1]):
            cluster, distance, _ = annuli.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the least hashes; a row for each centroid."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids of the vectors nearest to each; an empty one stays where it is."""
    size = centroids.shape[1]
    parts = vectors.select("v").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    # sums of longs, exact up to 2 ** 63: tasks and then Spark add them, and a row for each centroid comes back
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(size)]).alias("sums"))
    out = centroids.copy()
    for r in summed.collect():
        out[r.cluster] = [s // r.n for s in r.sums]
    return out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Whole-number vectors(vec_id, v) -> centroids; fewer than ``clusters`` where there are fewer vectors."""
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        held = moved(vectors, centroids)
        if (held == centroids).all():  # all later rounds would give the same
            break
        centroids = held
    return centroids


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    A row for each vector of exactly ``size`` components, none null, not a number or infinite, or so large (2 ** 17)
    that a squared distance would not be a long; the others go. The first centroids are the vectors with the least
    hashes; rows that repeat an id tie, and their components decide; a null id comes last. Equal distances go to the
    smaller number. Fewer vectors than clusters give as many centroids as there are vectors; none give no rows. Other
    columns are ignored. Sums and distances are exact while they fit 64 bits.
    """
    spark = vectors.sparkSession
    held = stored(whole(vectors.select("vec_id", "embedding"), size))
    centroids = fit(held, clusters, rounds, seed)
    if not len(centroids):
        return held.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    found = stored(held.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    # a row for each centroid, whatever the number of vectors
    of = {r.cluster: r.s for r in cut(found.groupBy("cluster").agg(F.sum("distance").alias("s"))).collect()}
    rows = [(k, s, sum(of.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in of.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
