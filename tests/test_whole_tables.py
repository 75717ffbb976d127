"""Queries take every row of their tables: words, media, days and vectors."""

import math

import pytest
from pyspark.sql import functions as F

from gramtide.operators import spectral
from gramtide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["calendar_fill", "windows_array", "share_series"])
def test_all_brands(spark, name):
    want = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").join(spark.read.parquet(f"{SF}/lineitem.parquet"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand").distinct().collect()}
    assert {r.mot for r in catalog.QUERIES[name](spark, SF).select("mot").distinct().collect()} == want


def test_shares_of_a_day_make_one(spark):
    assert all(abs(r.s - 1) < 1e-6 for r in catalog.QUERIES["share_series"](spark, SF).groupBy("date").agg(F.sum("share").alias("s")).collect())


def test_grams_of_all_media_and_days(spark, tmp_path):
    rows = [(1, "the of cat", "en", "s"), (2, "der und hund", "de", "s"), (14, "the dog", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.gram, r.stop) for r in catalog.QUERIES["stop_flag"](spark, str(tmp_path)).collect()} == {("the of", True), ("of cat", False), ("der und", True), ("und hund", False), ("the dog", False)}
    got = sorted((r.w1, r.w2, r.date, r.n) for r in catalog.QUERIES["decode_tokens"](spark, str(tmp_path)).collect())
    assert got == [("der", "und", 20240103, 1), ("of", "cat", 20240102, 1), ("the", "dog", 20240115, 1), ("the", "of", 20240102, 1), ("und", "hund", 20240103, 1)]


@pytest.mark.parametrize("block", [512, 16])
def test_kernel_of_all_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "KERNEL_BLOCK", block)
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {(r.i, r.j): r.k for r in catalog.QUERIES["rbf_gram"](spark, SF).collect()}
    want = {(i, j): math.exp(-0.05 * sum((a - b) ** 2 for a, b in zip(v[i], v[j], strict=True))) for i in v for j in v if i <= j}
    assert len(v) > 60 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
