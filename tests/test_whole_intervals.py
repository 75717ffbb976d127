"""Intervals and control charts over all snapshots."""

import math

import pytest

from gramtide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rates(spark):
    """Per event type: the rates of all consecutive events."""
    found = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        found.setdefault(r.event_type, []).append(float(math.floor(r.value) % 2 == 0))
    return {k: v[1:] for k, v in found.items()}


def test_intervals_of_all_snapshots(spark, rates):
    got = {}
    for r in catalog.QUERIES["interval_rates"](spark, SF).orderBy("batch").collect():
        got.setdefault(r.media, []).append(r.rate)
    assert got == rates


def test_bounds_of_all_snapshots(spark, rates):
    def bound(v):
        mean = sum(v) / len(v)
        return mean - 3 * math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1))

    assert {r.media: r.bound for r in catalog.QUERIES["control_bound"](spark, SF).collect()} == pytest.approx({k: bound(v) for k, v in rates.items()}, abs=1e-7)
    chart = {r.media: (r.history, r.bound) for r in catalog.QUERIES["control_chart"](spark, SF).collect()}
    assert {k: c[0] for k, c in chart.items()} == {k: len(v) - 1 for k, v in rates.items()}
    assert {k: c[1] for k, c in chart.items()} == pytest.approx({k: bound(v[:-1]) for k, v in rates.items()}, abs=1e-7)
