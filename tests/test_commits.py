"""The commit protocol of the n-gram store."""

from pyspark.sql import functions as F

from gramtide.sources import commits, writers
from gramtide.streaming import incremental

ARTICLE = "id long, media string, date int, contenu string"


def _counts(spark, store, version=None):
    return {r.gram: r.n for r in incremental.stored_counts(spark, store, version).collect()}


def _rows(spark, *texts, start=0):
    return spark.createDataFrame([(start + i, "m", 20240101, x) for i, x in enumerate(texts)], ARTICLE)


def test_second_writer_from_zero(spark, tmp_path):
    """A second stream numbers its batches from 0 again; nothing of the first is lost."""
    store = str(tmp_path / "s")
    assert incremental.upsert(_rows(spark, "a"), store, 0, writer="one")
    assert incremental.upsert(_rows(spark, "b", start=5), store, 0, writer="two")
    assert incremental.upsert(_rows(spark, "zz", start=9), store, 0, writer="two")  # a batch that runs again: known
    assert _counts(spark, store) == {"a": 1, "b": 1}


def test_first_batch_after_compaction(spark, tmp_path):
    store, other = str(tmp_path / "s"), str(tmp_path / "c")
    incremental.upsert(_rows(spark, "a a"), store, 0, writer="one")
    incremental.upsert(_rows(spark, "b", start=5), store, 1, writer="one")
    incremental.compact(spark, store, other)
    assert incremental.upsert(_rows(spark, "c", start=7), other, 0, writer="two")
    assert incremental.upsert(_rows(spark, "x x", "x"), other, 1, writer="two")  # id 0 is known, id 1 new
    assert _counts(spark, other) == {"a": 2, "b": 1, "c": 1, "x": 1}


def test_readers_keep_their_version(spark, tmp_path):
    store = str(tmp_path / "s")
    incremental.upsert(_rows(spark, "a"), store, 0)
    old = incremental.stored_counts(spark, store)
    incremental.upsert(_rows(spark, "b", start=5), store, 1)
    incremental.compact(spark, store)
    assert {r.gram for r in old.collect()} == {"a"} and _counts(spark, store, 0) == {"a": 1}
    assert _counts(spark, store) == {"a": 1, "b": 1} and commits.versions(spark, store) == [0, 1, 2]
    gone = incremental.vacuum(spark, store, keep=1, hours=0)
    assert len(gone) == 2 and _counts(spark, store) == {"a": 1, "b": 1} and commits.versions(spark, store) == [2]
    assert incremental.upsert(_rows(spark, "zz"), store, 1)  # still known as done


def test_loser_counts_anew(spark, tmp_path, monkeypatch):
    """Another writer commits the same ids between reading and committing: they count once."""
    store, real, raced = str(tmp_path / "s"), commits.commit, []

    def late(spark_, root, base, held):
        if not raced:
            raced.append(1)
            incremental.upsert(_rows(spark, "a"), store, 0, writer="rival")
        return real(spark_, root, base, held)

    monkeypatch.setattr(commits, "commit", late)
    assert incremental.upsert(_rows(spark, "a", "b"), store, 0, writer="us")
    assert _counts(spark, store) == {"a": 1, "b": 1}
    assert incremental.vacuum(spark, store, hours=0)  # the attempt that lost


def test_failed_attempt_leaves_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    incremental.upsert(_rows(spark, "a"), store, 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", crash)
        try:
            incremental.upsert(_rows(spark, "b", start=5), store, 1)
        except OSError:
            pass
    assert _counts(spark, store) == {"a": 1}
    assert incremental.upsert(_rows(spark, "b", start=5), store, 1) and _counts(spark, store) == {"a": 1, "b": 1}


def test_null_and_repeated_ids(spark, tmp_path):
    store = str(tmp_path / "s")
    rows = [(None, "m", 20240101, "n"), (None, "m", 20240101, "n"), (1, "m", 20240102, "late"), (1, "m", 20240101, "early")]
    df = spark.createDataFrame(rows, ARTICLE)
    incremental.upsert(df, store, 0)
    incremental.upsert(df.orderBy(F.desc("date")), store, 0)
    assert _counts(spark, store) == {"n": 2, "early": 1}
    assert _counts(spark, str(tmp_path / "none")) == {}


def test_stream_from_a_new_checkpoint(spark, tmp_path):
    store, files = str(tmp_path / "s"), str(tmp_path / "f")
    _rows(spark, "a", "b", "c").repartition(3).write.parquet(files)
    source = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).parquet(files)
    for name in "xy":
        incremental.drain(incremental.stream_upsert(source, store, str(tmp_path / name)))
        _rows(spark, "d", start=7).write.mode("append").parquet(files)
    assert _counts(spark, store) == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_exports_are_whole(spark, tmp_path, monkeypatch):
    """A crash while an export is written leaves the old one; repeats of a row count as a change."""
    out = str(tmp_path / "e")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert writers.published(spark, out) is None and writers.publish_if_changed(rows, out)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *_: 1 / 0)
        try:
            writers.publish_if_changed(rows.limit(1), out)
        except ZeroDivisionError:
            pass
    assert writers.published(spark, out).count() == 2
    assert not writers.publish_if_changed(rows.orderBy(F.desc("k")), out)
    assert writers.publish_if_changed(rows.unionByName(rows.where("k = 1")), out)
    assert writers.published(spark, out).count() == 3 and writers.published(spark, out, 0).count() == 2


def test_append_meets_a_rival(spark, tmp_path, monkeypatch):
    out, real, raced = str(tmp_path / "a"), commits.commit, []
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")

    def late(*args):
        if not raced:
            raced.append(1)
            writers.append_new(rows.where("k = 1"), out, ["k"])
        return real(*args)

    monkeypatch.setattr(commits, "commit", late)
    assert writers.append_new(rows, out, ["k"]) == 1  # the row without a key
    assert writers.append_new(rows, out, ["k"]) == 0 and writers.published(spark, out).count() == 2
