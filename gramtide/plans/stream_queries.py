"""Incremental and streaming queries, run to the end of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental, state
from .registry import query, sql
from .string_queries import _folder
from .tables import Tables


@query("incremental_upsert", sql("SELECT media, date, gram, n FROM uni", "uni"))
def incremental_upsert(t: Tables):
    """Articles that come in three overlapping batches, one of them twice, count once."""
    store = _folder(t, "upsert")
    for token, part in enumerate(("id % 2 = 0", "id % 3 = 0", "id % 3 = 0", "true")):
        incremental.upsert(t.dealt.where(part), store, min(token, 2) if token < 3 else 3)
    return incremental.stored_counts(t.spark, store)


@query("stream_upsert", sql("SELECT media, date, gram, n FROM uni", "uni"))
def stream_upsert(t: Tables):
    """The same from a stream of files."""
    store, files = _folder(t, "stream"), _folder(t, "files")
    t.articles.select("id", "media", "date", "contenu").repartition(3).write.parquet(files)
    source = t.spark.readStream.schema("id long, media string, date int, contenu string").option("maxFilesPerTrigger", 2).parquet(files)
    incremental.drain(incremental.stream_upsert(source, store, _folder(t, "state")))
    return incremental.stored_counts(t.spark, store)


#: Events of a file of the feed, about, and files of a micro-batch.
FEED_ROWS, FEED_FILES = 200_000, 8


def _events(t: Tables):
    """Events as a feed of files in the order of time: a range of times each, their ages in the order of the ranges."""
    files = _folder(t, "events")
    events = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = max(2, -(-events.count() // FEED_ROWS))
    events.repartitionByRange(parts, F.col("ts").asc_nulls_first()).write.parquet(files)
    incremental.aged(t.spark, files)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", min(FEED_FILES, -(-parts // 2))).parquet(files)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables):
    """First rows of each key; the window spans the table, so nothing comes back."""
    out = _folder(t, "dedup")
    rows = incremental.deduplicated(_events(t), ["user_id", "event_type"], "ts", "100 days").select("user_id", "event_type")
    incremental.drain(rows.writeStream.format("parquet").option("checkpointLocation", _folder(t, "state")).trigger(availableNow=True).start(out))
    return t.spark.read.schema("user_id long, event_type string").parquet(out)


@query("stream_windows", "SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 12 HOURS, ts::TIMESTAMP, TIMESTAMP '2024-01-01') AS start, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_windows(t: Tables):
    """Half-days that the watermark has closed."""
    out = _folder(t, "windows")
    rows = incremental.windowed(_events(t), "ts", "12 hours", "1 hour", "event_type").select("event_type", F.col("w.start").alias("start"), "n")
    incremental.drain(rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _folder(t, "state")).trigger(availableNow=True).start(out))
    return t.spark.read.schema("event_type string, start timestamp, n long").parquet(out)


@query("stream_returns", "SELECT user_id, event_type, min(ts)::TIMESTAMP AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 48 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, visit HAVING max(ts) + INTERVAL 48 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_returns(t: Tables):
    """Keys as they come, and again when 48 hours passed without them: stays in a feed that the watermark has closed."""
    out = _folder(t, "returns")
    incremental.drain(incremental.stays(_events(t), ["user_id", "event_type"], "ts").writeStream.format("parquet").option("checkpointLocation", _folder(t, "state")).trigger(availableNow=True).start(out))
    return t.spark.read.schema("user_id long, event_type string, start timestamp, n long").parquet(out)


@query("stream_url_state", "SELECT user_id AS id, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 60) > 0 THEN 2 WHEN count(*) FILTER (event_type = 'error') > 1 THEN 4 WHEN count(*) FILTER (event_type = 'error') = 1 THEN 1 WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 3 ELSE 0 END AS state FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_url_state(t: Tables):
    """States of URLs after all batches, from the log of changes: errors are attempts, purchases covered elsewhere."""
    out = _folder(t, "states")
    kind = F.when(F.col("event_type") == "error", F.when(F.col("value") > 60, "ok").otherwise("failed")).when(F.col("event_type") == "purchase", "covered").otherwise("new")
    stream = _events(t).select(F.col("user_id").alias("id"), kind.alias("kind"))
    state.run(state.url_changes(stream), out, _folder(t, "state"))
    return state.last_states(t.spark.read.schema("id long, seq long, old int, state int").parquet(out))


def _progress(t: Tables):
    """Outcomes by event type and hour through keyed state."""
    out = _folder(t, "progress")
    stream = _events(t).withColumnRenamed("event_type", "media")
    state.run(state.progress(stream, "ts", F.floor("value") % 2 == 0), out, _folder(t, "state"))
    return t.spark.read.schema(state.PROGRESS).parquet(out)


_HOURS = """(SELECT *, row_number() OVER w - 1 AS history, sum(o) OVER w::BIGINT AS ok, sum(b) OVER w::BIGINT AS bad, o / (o + b) AS rate FROM (
    SELECT event_type AS media, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) FILTER (floor(value)::BIGINT % 2 = 0) AS o, count(*) FILTER (floor(value)::BIGINT % 2 <> 0 OR value IS NULL) AS b FROM events GROUP BY ALL
) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR WINDOW w AS (PARTITION BY media ORDER BY start ROWS UNBOUNDED PRECEDING))"""


@query("stream_trigger", f"SELECT media, start, ok, bad, step FROM (SELECT *, (ok + bad) // 100 AS step, (ok + bad - o - b) // 100 AS before FROM {_HOURS}) WHERE step > before")
def stream_trigger(t: Tables):
    """Hours in which another hundred outcomes of a medium were full."""
    return _progress(t).where("step IS NOT NULL").select("media", F.col("at").alias("start"), "ok", "bad", "step")


_PAST = f"(SELECT *, avg(rate) OVER p AS mean, stddev_samp(rate) OVER p AS sigma FROM {_HOURS} WINDOW p AS (PARTITION BY media ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("stream_chart", f"SELECT media, start, history, round(rate, 8) AS rate, round(mean - 3 * sigma, 8) AS bound, rate < mean - 3 * sigma AS alert FROM {_PAST} WHERE history >= 5 AND sigma > 0")
def stream_chart(t: Tables):
    """Each hour's success rate against the bound of the hours before it, as the stream goes on."""
    return _progress(t).where("bound IS NOT NULL").select("media", F.col("at").alias("start"), "history", F.round("rate", 8).alias("rate"), F.round("bound", 8).alias("bound"), "alert")


_LEVELS = "(SELECT level, hr >> level AS k, count(*) AS n FROM (SELECT floor(epoch(ts) / 3600 - 473352)::BIGINT AS hr FROM events), (SELECT unnest(range(0, 13))::INT AS level) GROUP BY ALL)"


@query("slice_bisect", f"SELECT (k << level) AS a, ((k + 1) << level) AS b, n FROM {_LEVELS} s WHERE (n < 100 OR level = 0) AND (level = 12 OR EXISTS (SELECT 1 FROM {_LEVELS} u WHERE u.level = s.level + 1 AND u.k = s.k >> 1 AND u.n >= 100))")
def slice_bisect(t: Tables):
    hours = t.raw("events").select(F.floor(F.unix_timestamp("ts") / 3600 - 473_352).cast("long").alias("at"))
    return incremental.bisected(hours, "at", 100, 12)
