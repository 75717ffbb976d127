"""State by key across the micro-batches of a stream: states of URLs, progress counters with their control chart.

What a key holds is a few numbers, whatever it has seen. Rows are combined before they are shuffled (by batch of Arrow rows
for URLs, by window for counters), so a key with a large share of all rows sends few. State lives in RocksDB and in the
checkpoint folder: a batch that fails runs again from the state before it, and a file sink takes its rows once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.monitor import MIN_HISTORY, SIGMAS
from .incremental import drain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as processors ask for; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what a stream gives to Parquet files until its source is used up; goes on from a checkpoint."""
    with rocksdb(rows.sparkSession):
        query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    drain(query)


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none")


# URLs

#: fixed values: what becomes of a URL
NEW, FAILED, DONE, COVERED, GIVEN_UP = 0, 1, 2, 3, 4


def url_state(worked: bool, failed: int, covered: bool) -> int:
    """Done once an attempt worked; else given up from the second failure; covered elsewhere only without attempts."""
    if worked:
        return DONE
    return GIVEN_UP if failed > 1 else FAILED if failed else COVERED if covered else NEW


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield df.groupby("id", as_index=False).agg(worked=("worked", "max"), failed=("failed", "sum"), covered=("covered", "max"))


class UrlStates(StatefulProcessor):
    """Holds (worked, failures, covered, changes) of a URL and gives a row whenever its state changes."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "worked boolean, failed long, covered boolean, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        worked, failed, covered, seq = self.held.get() if self.held.exists() else (False, 0, False, 0)
        old = url_state(worked, failed, covered) if seq else None
        for df in rows:
            worked |= bool(df["worked"].any())
            failed += int(df["failed"].sum())
            covered |= bool(df["covered"].any())
        now = url_state(worked, failed, covered)
        self.held.update((worked, failed, covered, seq + (now != old)))
        if now != old:
            yield pd.DataFrame({"id": [key[0]], "seq": [seq + 1], "old": pd.array([old], "Int64"), "state": [now]})

    def close(self) -> None:
        pass


def url_changes(stream: DataFrame, kind: str = "kind") -> DataFrame:
    """A stream of (id, kind) -> (id, seq, old, state), a row for each change; ``old`` is null for a new URL.

    Kinds: ``ok``, ``failed``, ``covered`` (read under another address); any other, or null, only makes the URL known.
    The last state depends on what came, not on its order or how it was cut into batches. Rows without an id go.
    """
    is_ = lambda name: F.coalesce(F.col(kind) == name, F.lit(False))
    rows = stream.where("id IS NOT NULL").select("id", is_("ok").alias("worked"), is_("failed").cast("long").alias("failed"), is_("covered").alias("covered"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}"
    rows = rows.mapInPandas(_combined, f"{schema}, worked boolean, failed long, covered boolean")
    return _keyed(rows, "id", UrlStates(), f"{schema}, seq long, old int, state int")


def last_states(changes: DataFrame) -> DataFrame:
    """(id, state) after all changes."""
    return changes.groupBy("id").agg(F.max_by("state", "seq").alias("state"))


# counters


class Progress(StatefulProcessor):
    """Holds a medium's counters and the moments of its rates; gives a row for each window with what it adds.

    Windows come closed and, over batches, in the order of time, so only those of one batch are sorted.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "ok long, bad long, history long, mean double, squares double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ok, bad, history, mean, squares = self.held.get() if self.held.exists() else (0, 0, 0, 0.0, 0.0)
        out = []
        for at, done, lost in pd.concat(rows).sort_values("at")[["at", "ok", "bad"]].itertuples(index=False):
            if not done + lost:
                continue
            before = (ok + bad) // self.every
            ok, bad = ok + int(done), bad + int(lost)
            step = (ok + bad) // self.every
            rate = done / (done + lost)
            sigma = math.sqrt(squares / (history - 1)) if history > 1 else 0.0
            known = history >= MIN_HISTORY and sigma > 0
            bound = mean - SIGMAS * sigma if known else None
            out.append((key[0], at, ok, bad, step if step > before else None, history, rate, mean if known else None, sigma if known else None, bound, known and rate < bound))
            history += 1
            off = rate - mean
            mean += off / history
            squares += off * (rate - mean)
        self.held.update((ok, bad, history, mean, squares))
        df = pd.DataFrame(out, columns=[c.split()[0] for c in PROGRESS.split(", ")])
        yield df.astype({"step": "Int64"})

    def close(self) -> None:
        pass


PROGRESS = "media string, at timestamp, ok long, bad long, step long, history long, rate double, mean double, sigma double, bound double, alert boolean"


def progress(stream: DataFrame, time: str, ok: Column, size: str = "1 hour", late: str = "1 hour", every: int = 100) -> DataFrame:
    """A stream of single outcomes (media, time) -> a row (``PROGRESS``) for each medium and window that the watermark closed.

    ``ok``, ``bad``: counters so far. ``step``: the multiple of ``every`` that this window reached or passed, else null.
    ``rate``: success within the window, held against the bound of the windows before it (mean less three sample
    deviations, from five windows on that aren't all alike). Outcomes that are null are failures; those without a time, or
    later than ``late``, go; a null medium is a medium.
    """
    good = F.coalesce(ok, F.lit(False)).cast("long")
    rows = stream.where(F.col(time).isNotNull()).withColumn("__ok", good).withWatermark(time, late)
    sums = rows.groupBy("media", F.window(time, size).alias("w")).agg(F.sum("__ok").alias("ok"), F.count("*").alias("n"))
    return _keyed(sums.select("media", F.col("w.start").alias("at"), "ok", (F.col("n") - F.col("ok")).alias("bad")), "media", Progress(every), PROGRESS)
