"""Monitoring of a collection: progress, rates, control charts, article statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, small_enough
from .quantiles import exact

MIN_HISTORY, SIGMAS = 5, 3.0
# fixed values: 0 to do, 1 failed once, 2 done, 3 covered elsewhere, 4 failed again, 5 no article


def percent(a: Column, b: Column) -> Column:
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), 1)


def progress(queue: DataFrame) -> DataFrame:
    """By media and in all (media ``TOTAL``): todo, failed, done, total, percent treated and of success."""
    n = lambda *states: F.sum(F.col("state").isin(*states).cast("long"))
    rows = queue.rollup("media").agg(F.grouping("media").alias("g"), n(0).alias("todo"), n(1, 4).alias("failed"), n(2).alias("done"))
    total, treated = F.col("todo") + F.col("failed") + F.col("done"), F.col("failed") + F.col("done")
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("media")).alias("media"), "todo", "failed", "done", total.alias("total"), percent(treated, total).alias("treated_pct"), percent(F.col("done"), treated).alias("success_pct"))


def failure_rate(queue: DataFrame) -> DataFrame:
    treated = queue.where(F.col("state").isin(1, 2, 4))
    return treated.groupBy("media").agg(F.count("*").alias("treated"), F.round(100.0 * F.avg((F.col("state") != 2).cast("int")), 1).alias("failure_pct"))


def length_stats(articles: DataFrame, words: Column) -> DataFrame:
    """Lengths by medium and of all (TOTAL): each article counts in both."""
    of = articles.select("media", words.alias("w"))
    both = cut(of.select(F.explode(F.array(F.struct(F.lit(0).alias("g"), "media"), F.struct(F.lit(1).alias("g"), F.lit("TOTAL").alias("media")))).alias("s"), "w").select("s.g", "s.media", "w"))
    medians = exact(both, ["g", "media"], "w", (0.5,)).select("g", F.col("media").alias("of"), F.bround(F.col("v")[0], 0).alias("median"))
    rows = both.groupBy("g", "media").agg(F.count("*").alias("n"), F.bround(F.avg("w"), 0).alias("mean"), F.min("w").alias("min"), F.max("w").alias("max")).withColumnRenamed("g", "kind")
    return rows.join(F.broadcast(medians) if small_enough(medians) else medians, (F.col("kind") == F.col("g")) & F.col("media").eqNullSafe(F.col("of")), "left").select("media", "n", "mean", "median", "min", "max")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values of a field that joins values by ', '."""
    values = df.select(F.explode(F.split(column, ", ")).alias("value")).select(F.trim("value").alias("value")).where("value <> ''")
    return values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def intervals(snapshots: DataFrame) -> DataFrame:
    """Cumulative counters -> (media, batch, ts, n, rate): growth between successive rows, never under 0; empty ones go."""
    w = Window.partitionBy("media").orderBy("ts", "event_id")
    grown = lambda c: F.greatest(F.lit(0), F.col(c) - F.lag(c).over(w))
    rows = snapshots.withColumn("done", grown("ok")).withColumn("n", F.col("done") + grown("bad")).where("n > 0")
    return rows.select("media", F.row_number().over(w).alias("batch"), "ts", "event_id", "n", (F.col("done") / F.col("n")).alias("rate"))


def control_chart(intervals: DataFrame) -> DataFrame:
    """Per media: mean, deviation and lower bound of all intervals but the last, and whether the last is below it."""
    last = F.row_number().over(Window.partitionBy("media").orderBy(F.desc("batch"))) == 1
    rows = intervals.withColumn("last", last)
    past = F.when(~F.col("last"), F.col("rate"))
    out = rows.groupBy("media").agg(F.count(past).alias("history"), F.avg(past).alias("mean"), F.stddev_samp(past).alias("sigma"), F.max(F.when(F.col("last"), F.col("rate"))).alias("rate"))
    out = out.where((F.col("history") >= MIN_HISTORY) & (F.col("sigma") > 0)).withColumn("bound", F.col("mean") - SIGMAS * F.col("sigma"))
    return out.withColumn("alert", F.col("rate") < F.col("bound"))


def control_bound(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("media").agg((F.avg("rate") - SIGMAS * F.stddev_samp("rate")).alias("bound"))


def success_windows(snapshots: DataFrame, hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """Latest counters of each media, its success rate, and that of the last 24 and 72 hours before the newest row."""
    newest = snapshots.agg(F.max("ts").alias("newest"))
    rows = snapshots.crossJoin(F.broadcast(newest))
    place = F.struct("ts", "event_id")
    sums = [F.max_by("ok", place).alias("ok"), F.max_by("bad", place).alias("bad")]
    for h in hours:
        old = F.col("ts") <= F.col("newest") - F.expr(f"interval {h} hours")
        sums += [F.max_by("ok", F.when(old, place)).alias(f"ok{h}"), F.max_by("bad", F.when(old, place)).alias(f"bad{h}")]
    out = rows.groupBy("media").agg(*sums)
    rates = [percent(F.col("ok") - F.col(f"ok{h}"), F.col("ok") + F.col("bad") - F.col(f"ok{h}") - F.col(f"bad{h}")).alias(f"pct{h}") for h in hours]
    return out.select("media", "ok", "bad", percent(F.col("ok"), F.col("ok") + F.col("bad")).alias("pct"), *rates)


def count_trigger(snapshots: DataFrame, every: int) -> DataFrame:
    """The rows at which at least ``every`` more were treated since the last multiple: one snapshot for each step."""
    w = Window.partitionBy("media").orderBy("ts", "event_id")
    step = F.floor((F.col("ok") + F.col("bad")) / every)
    return snapshots.withColumn("step", step).withColumn("old", F.coalesce(F.lag("step").over(w), F.lit(0))).where("step > old").drop("old")


def stop_page(pages: DataFrame, crawl: str, page: str, bad: Column, limit: int) -> DataFrame:
    """(crawl, stop): the page at which a crawl stops, the first that is the ``limit``-th bad one in a row; null if none."""
    window = Window.partitionBy(crawl).orderBy(page).rowsBetween(1 - limit, 0)
    rows = pages.withColumn("__bad", F.sum(bad.cast("int")).over(window))
    return rows.groupBy(crawl).agg(F.min(F.when(F.col("__bad") == limit, F.col(page))).alias("stop"))


def days_to_do(ledger: DataFrame, title: str, day: str, ok: str, through: Column) -> DataFrame:
    """(title, day) that a run that goes on has to do: days that failed, and those after the last finished one."""
    done = ledger.groupBy(title).agg(F.max(F.when(F.col(ok), F.col(day))).alias("last"), F.min(day).alias("first"))
    after = F.expr("if(last is null, first, date_add(last, 1))")
    new = done.withColumn("through", through).where(after <= F.col("through")).select(title, F.explode(F.sequence(after, F.col("through"))).alias(day))
    failed = ledger.where(~F.col(ok)).select(title, day)
    return failed.unionByName(new).distinct()
