import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramtide.llm import annulus
from gramtide.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, clusters, rounds, size):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in kept[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((far(v, c), k) for k, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        of = [k for _, k in assign()]
        for k in range(len(cs)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            if own:
                cs[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = assign()
    total = sum(d for d, _ in last)
    return sorted(((i is None, i or 0), k, d, sum(e for e, o in last if o == k), total, hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last, strict=True))


def got(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), *tuple(r)[1:]) for r in df.collect())


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("v", "cluster", "distance", "n", "sums", "inertia", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.3, 5).tolist()) for k in range(120)]
    rows += [(7, rows[8][1]), (7, rows[9][1]), (None, [0.1] * 5), (None, [0.2] * 5)] + [(200 + k, [0.25] * 5) for k in range(20)]  # repeated ids and copies
    rows += [(300, None), (301, []), (302, [0.1] * 4), (303, [0.1] * 6), (304, [0.1, None, 0.0, 0.0, 0.0]), (305, [0.1, math.nan, 0.0, 0.0, 0.0]), (306, [math.inf, 0.0, 0.0, 0.0, 0.0]), (307, [-0.0] * 5), (308, [1000.5, -1000.5, 0.0, 0.0, 0.0])]
    assert got(annulus.cluster(frame(spark, rows), 6, 10, 3, 5)) == brute(rows, 6, 10, 5)


def test_ties_and_few_vectors(spark):
    grid = [(k, [float(k % 3), float(k // 3 % 3)]) for k in range(27)]  # whole points, many at equal distances
    assert got(annulus.cluster(frame(spark, grid), 4, 10, 3, 2)) == brute(grid, 4, 10, 2)
    few = [(1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert got(annulus.cluster(frame(spark, few), 8, 10, 3, 2)) == brute(few, 8, 10, 2)
    assert annulus.cluster(frame(spark, [])).count() == 0
    assert annulus.cluster(frame(spark, [(1, [1e30] * 64), (2, [0.0])])).count() == 0  # no distance that is a long


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=20), st.sampled_from([1, 1000, annulus.LARGEST // 6]))
def test_annuli_hold_the_nearest(centroids, vectors, scale):
    c, x = np.array(centroids, np.int64) * scale, np.array(vectors, np.int64) * scale
    cluster, distance, compared = annulus.Annuli(c).nearest(x)
    want = [min((int(((v - m) ** 2).sum()), k) for k, m in enumerate(c)) for v in x]
    assert [(d, k) for d, k in zip(distance.tolist(), cluster.tolist(), strict=True)] == want
    assert compared <= len(c) * len(x)


def test_annuli_leave_far_norms_out():
    rng = np.random.default_rng(3)
    c = (rng.normal(size=(64, 8)) * np.geomspace(1, 1e6, 64)[:, None]).astype(np.int64)
    x = c.repeat(5, 0) + rng.integers(-2, 3, (320, 8))
    assert annulus.Annuli(c).nearest(x)[2] < 0.3 * len(c) * len(x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    mine = QUERIES["op13_clustering"](spark, f"/root/testdata/{sf}")
    want = con.sql(f"SELECT {', '.join(mine.columns)} FROM ({ORACLE_SQL['op13_clustering']})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(want)
