"""Keyed state over any cut of the input, and after a batch that was killed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gramtide.operators import monitor, urls
from gramtide.streaming import state

TRIES = "id long, kind string"


def _stream(spark, df, path, files, per_batch=1):
    df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _expected(rows):
    out = {}
    for i in {i for i, _ in rows if i is not None}:
        kinds = [k for j, k in rows if j == i]
        tries = [k for k in kinds if k in ("ok", "failed")]
        if "ok" in tries:
            out[i] = 2
        elif tries:
            out[i] = 1 if len(tries) == 1 else 4
        else:
            out[i] = 3 if "covered" in kinds else 0
    return out


ROWS = [(random.Random(7 * i).randrange(40), random.Random(i).choice(["ok", "failed", "failed", "covered", "new", None])) for i in range(120)] + [(None, "ok"), (99, None), (98, "covered"), (1, "failed"), (1, "failed")]


@pytest.mark.parametrize("files", [1, 4])
def test_url_states_over_any_cut(spark, tmp_path, files):
    df = spark.createDataFrame(ROWS, TRIES)
    stream = _stream(spark, df, str(tmp_path / "in"), files)
    state.run(state.url_changes(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    log = spark.read.parquet(str(tmp_path / "out"))
    assert {r.id: r.state for r in state.last_states(log).collect()} == _expected(ROWS)
    seen = {}
    for r in log.orderBy("id", "seq").collect():  # each change starts where the one before ended
        assert r.old == seen.get(r.id) and r.state != r.old
        seen[r.id] = r.state
    tries = df.where("kind in ('ok', 'failed') and id is not null").select("id", F.lit(0).alias("at"), (F.col("kind") == "ok").alias("ok"))
    assert {r.id: r.state for r in urls.state_after(tries).collect()}.items() <= _expected(ROWS).items()


class Killed(state.UrlStates):
    """Fails in the third batch as long as a file is there."""

    def __init__(self, flag):
        self.flag = flag

    def handleInputRows(self, key, rows, timers):
        import os

        yield from super().handleInputRows(key, rows, timers)
        if key[0] == 77 and os.path.exists(self.flag):
            raise RuntimeError("killed")


def test_states_after_a_killed_batch(spark, tmp_path, monkeypatch):
    flag, source, out, cp = (str(tmp_path / n) for n in ("flag", "in", "out", "cp"))
    open(flag, "w").close()
    monkeypatch.setattr(state, "UrlStates", lambda: Killed(flag))
    parts = [[(1, "failed"), (2, "failed")], [(1, "failed"), (77, "new")], [(2, "ok"), (77, "failed")]]
    for p in parts:
        spark.createDataFrame(p, TRIES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(TRIES).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(Exception):
        state.run(state.url_changes(stream), out, cp)
    (tmp_path / "flag").unlink()
    state.run(state.url_changes(stream), out, cp)
    log = spark.read.parquet(out)
    assert sorted((r.id, r.seq, r.old, r.state) for r in log.where("id < 3").collect()) == [(1, 1, None, 1), (1, 2, 1, 4), (2, 1, None, 1), (2, 2, 1, 2)]
    assert {r.id: r.state for r in state.last_states(log).collect()} == {1: 4, 2: 2, 77: 1}


def _outcomes(spark):
    pick, start, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for h in range(40):
        for m, share in (("a", 0.9 if h != 30 else 0.1), ("b", 0.7), (None, 0.5)):
            for _ in range(pick.randrange(0, 9) + (5 if h == 30 else 0)):
                rows.append((m, start + dt.timedelta(hours=h, seconds=pick.randrange(3600)), pick.random() < share))
    rows.append(("a", start + dt.timedelta(hours=45), None))  # closes what is before
    rows.append(("a", None, True))
    return spark.createDataFrame(rows, "media string, ts timestamp, ok boolean")


@pytest.mark.parametrize("files", [1, 3])
def test_progress_equals_the_batch_chart(spark, tmp_path, files):
    df = _outcomes(spark)
    path = str(tmp_path / "in")
    for i in range(files):  # files in the order of time, a batch each
        df.where(F.coalesce(F.least(F.floor((F.unix_timestamp("ts") - 1704067200) / 3600 / (46 / files)), F.lit(files - 1)), F.lit(0)) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state.run(state.progress(stream, "ts", F.col("ok"), every=10), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(state.PROGRESS).parquet(str(tmp_path / "out"))
    hours = df.where("ts < '2024-01-02 16:00:00'").groupBy("media", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.col("ok").cast("long")).alias("o"), F.count("*").alias("n"))
    rows = {}
    for r in hours.orderBy("ts").collect():
        rows.setdefault(r.media, []).append((r.ts, r.o, r.n - r.o))
    for m, line in rows.items():
        mine = {r["at"]: r for r in got.where(F.col("media").eqNullSafe(m)).collect()}
        assert set(mine) == {t for t, _, _ in line}
        ok = bad = 0
        snaps = []
        for i, (t, o, b) in enumerate(line):
            before, ok, bad = (ok + bad) // 10, ok + o, bad + b
            r = mine[t]
            assert (r["ok"], r["bad"], r["history"]) == (ok, bad, i)
            assert r["step"] == ((ok + bad) // 10 if (ok + bad) // 10 > before else None)
            snaps.append((m, t, i, o / (o + b)))
        for upto in (4, 6, 20, 31, len(snaps)):
            batch = spark.createDataFrame([(m, i + 1, r) for m, _, i, r in snaps[:upto]], "media string, batch int, rate double")
            chart = monitor.control_chart(batch).first()
            r = mine[snaps[:upto][-1][1]]
            assert (chart is None) == (r["bound"] is None)
            if chart:
                assert chart["alert"] == r["alert"] and abs(chart["bound"] - r["bound"]) < 1e-12
    assert got.where("alert").where("media = 'a'").count() >= 1
