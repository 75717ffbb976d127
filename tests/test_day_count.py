import pytest
from pyspark.sql import functions as F

from gramtide.operators import corr
from gramtide.plans import burst_queries, catalog
from gramtide.plans.tables import Tables

SF = "/root/testdata/sf0.001"


def days(spark):
    part, line = spark.read.parquet(f"{SF}/part.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_shipdate").cast("date")).distinct().count()


def test_noise_band_takes_the_days_of_the_series(spark):
    rows = catalog.QUERIES["mp_fit"](spark, SF).orderBy("rank").collect()
    n = days(spark)
    assert n != 2499
    import numpy as np

    _, _, low, high = corr.fit_noise(np.array([r.value for r in rows]), len(rows) / n)
    assert (rows[0].low, rows[0].high) == pytest.approx((low, high))


def test_denoised_takes_the_days_of_the_series(spark, monkeypatch):
    seen, real = [], corr.spikes
    monkeypatch.setattr(corr, "spikes", lambda found, n: seen.append(n) or real(found, n))
    burst_queries._denoised(Tables(spark, SF))
    assert seen == [days(spark)]
