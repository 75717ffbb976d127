"""Incremental stores and streams: idempotent micro-batches over a ledger, event-time deduplication, slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngrams
from ..sources import commits


COUNTS = "media string, date int, gram string, n long"


def _names(held: dict) -> list[str]:
    return [p["name"] for p in held.get("parts", [])]


def _read(spark: SparkSession, store: str, held: dict, what: str, schema: str) -> DataFrame | None:
    paths = [f"{commits.data(store, n)}/{what}" for n in _names(held)]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def one_of_each(batch: DataFrame) -> DataFrame:
    """One article for each id: of several the least by date, medium and text, whatever the order they come in.

    Articles without an id can't be told from one another: all of them stay.
    """
    rest = ["date", "media", "contenu"]
    least = batch.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", *[f"s.{c}" for c in rest])
    return least.unionByName(batch.where("id IS NULL").select("id", *rest))


def upsert(batch: DataFrame, store: str, token: int, size: int = 1, writer: str = "") -> bool:
    """Counts a batch of articles(id, media, date, contenu) into a store of partial counts; False if nothing was new.

    A commit adds one part: the counts of the batch and the ids that it counted, under a name that no other attempt has.
    Ids of earlier parts are left out, so an article counts once. ``writer`` (a stream's id) numbers its batches upwards
    with ``token``: one that is committed isn't counted again (True), so a restart neither loses nor doubles counts, and
    two writers, or a second stream that starts at 0, don't meet. If another writer commits first, the batch is counted
    anew against what that one brought. Articles without an id count in each batch that brings them.
    """
    spark = batch.sparkSession
    batch = one_of_each(batch)
    while True:
        held = commits.manifest(spark, store)
        if held.get("done", {}).get(writer, -1) >= token:
            return True
        ledger = _read(spark, store, held, "ids", "id long")
        fresh = batch if ledger is None else batch.join(ledger, "id", "left_anti")
        fresh = fresh.persist()
        try:
            if fresh.isEmpty():
                return False
            name = commits.fresh()
            ngrams.counts(fresh, size).write.parquet(f"{commits.data(store, name)}/counts")
            fresh.where("id IS NOT NULL").select("id").write.parquet(f"{commits.data(store, name)}/ids")
        finally:
            fresh.unpersist()
        part = {"name": name, "writer": writer, "token": token}
        after = {"parts": [*held.get("parts", []), part], "done": held.get("done", {}) | {writer: token}}
        if commits.commit(spark, store, held, after):
            return True


def stored_counts(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The counts of one version of a store, the newest by default; later commits don't change what this reads."""
    parts = _read(spark, store, commits.manifest(spark, store, version), "counts", COUNTS)
    if parts is None:
        return spark.createDataFrame([], COUNTS)
    return parts.groupBy("media", "date", "gram").agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, store: str, into: str | None = None) -> None:
    """Rewrites the parts of a store as one, in place or as a new store; which batches are done is kept.

    In place it is one more version. Readers of an older one keep its parts until ``vacuum``. If a batch is committed
    meanwhile, its part stays beside the new one.
    """
    held = commits.manifest(spark, store)
    into = into or store
    if not held.get("parts"):
        return
    name = commits.fresh()
    stored_counts(spark, store, held["version"]).repartitionByRange("gram").sortWithinPartitions("gram", "date").write.parquet(f"{commits.data(into, name)}/counts")
    _read(spark, store, held, "ids", "id long").write.parquet(f"{commits.data(into, name)}/ids")
    one = {"name": name, "writer": "compact", "token": held["version"]}
    while True:
        now = commits.manifest(spark, into)
        if into != store and now["version"] >= 0:
            raise ValueError(f"{into} is a store already")
        old = set(_names(held)) if into == store else set()
        if into == store and not old <= set(_names(now)):
            raise RuntimeError("another compaction came first")
        later = [p for p in now.get("parts", []) if p["name"] not in old]
        done = now.get("done", {}) if into == store else held.get("done", {})
        if commits.commit(spark, into, now, {"parts": [one, *later], "done": done}):
            return


def vacuum(spark: SparkSession, store: str, keep: int = 2, hours: float = 48.0) -> list[str]:
    """Removes parts that none of the last versions names: those that were compacted, and failed attempts."""
    return commits.vacuum(spark, store, _names, keep, hours)


def stream_upsert(source: DataFrame, store: str, checkpoint: str, size: int = 1):
    """Runs ``upsert`` for each micro-batch of a stream until its source is used up; the stream's id is the writer."""
    spark = source.sparkSession

    def count(df: DataFrame, n: int) -> None:
        upsert(df, store, n, size, spark.read.json(f"{checkpoint}/metadata").first()["id"])

    return source.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], time: str, window: str = "48 hours") -> DataFrame:
    """Drops repeats that come within the window; the state is bounded by the watermark."""
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(keys)


def stays(stream: DataFrame, keys: list[str], time: str, window: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """(keys, start, n): a key comes with its first row, and as a new stay once ``window`` has passed without it.

    A stay comes when the watermark closes it; until then its bounds are the state of a key. Unlike ``deduplicated``, what
    comes back doesn't hang on where the batches are cut. A row that comes just ``window`` after the last one is a new stay:
    Spark would join it, so its sessions are a microsecond shorter.
    """
    w = F.session_window(time, f"{window} -1 microseconds").alias("w")
    return stream.withWatermark(time, late).groupBy(*keys, w).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def windowed(stream: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))


def aged(spark: SparkSession, folder: str) -> None:
    """Gives the files of a folder ages in the order of their names, a second apart: a stream of files takes the oldest first.

    Tasks write side by side, so else a stream may meet late files before early ones and drop what these bring.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f for f in system.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in found), default=0)
    for k, f in enumerate(found):
        system.setTimes(f.getPath(), last - 1000 * (len(found) - 1 - k), -1)


def drain(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def bisect(count: Callable[[int, int], int], low: int, high: int, full: int) -> list[tuple[int, int, int]]:
    """Slices [a, b) of [low, high) with under ``full`` hits each; one that can't be cut further stays full."""
    out, todo = [], [(low, high)]
    while todo:
        a, b = todo.pop()
        n = count(a, b)
        if n >= full and b - a > 1:
            mid = (a + b) // 2
            todo += [(mid, b), (a, mid)]
        elif n:
            out.append((a, b, n))
    return sorted(out)


def bisected(events: DataFrame, at: str, full: int, levels: int = 24) -> DataFrame:
    """The same over a table of whole numbers ``at``: (a, b, n), by one aggregation and a walk up its levels.

    Dyadic slices of [0, 2^levels): a slice is cut while it holds ``full`` rows or more.
    """
    leaf = events.groupBy(F.col(at).alias("k")).agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    levels_ = [leaf]
    for i in range(1, levels + 1):
        levels_.append(levels_[0].groupBy(F.shiftright("k", i).alias("k")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(i)))
    every = levels_[0]
    for df in levels_[1:]:
        every = every.unionByName(df)
    fine = every.where((F.col("n") < full) | (F.col("level") == 0))
    above = every.where(F.col("n") >= full).select((F.col("level") - 1).alias("level"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("k"))
    top = every.where(F.col("level") == levels).select("level", "k")
    # a slice stands if it isn't cut and its parent is
    kept = fine.join(above.unionByName(top).distinct(), ["level", "k"], "left_semi")
    return kept.select((F.col("k") * F.pow(F.lit(2.0), "level")).cast("long").alias("a"), ((F.col("k") + 1) * F.pow(F.lit(2.0), "level")).cast("long").alias("b"), "n")
