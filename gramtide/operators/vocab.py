"""Vocabularies: census, exclusions, spelling variants, shared matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def census(grams: DataFrame) -> DataFrame:
    """(media, gram, active_days, total)."""
    return grams.groupBy("media", "gram").agg(F.count("*").alias("active_days"), F.sum("n").alias("total"))


def admissible(word: Column, stop: Sequence[str] = text.STOP_WORDS) -> Column:
    return ~word.isin(*stop) & ~word.rlike("^[0-9]") & (F.length(word) > 1)


def select_vocabulary(words: DataFrame, categories: DataFrame, rejected: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """words(gram, ...) without apostrophes, not rejected, of an allowed or unknown category."""
    rows = words.where(admissible(F.col("gram")) & ~F.contains("gram", F.lit("'"))).join(rejected.select("gram"), "gram", "left_anti")
    return rows.join(categories, "gram", "left").where(F.col("category").isin(*allowed) | F.col("category").isNull())


def filter_category(words: DataFrame, categories: DataFrame, kind: str) -> DataFrame:
    """kind: all, no_verbs (unknown words stay), nouns, proper."""
    rows = words.join(categories, "gram", "left")
    c = F.col("category")
    return {"all": rows, "no_verbs": rows.where(~c.eqNullSafe("verb")), "nouns": rows.where(c.isin("noun", "proper")), "proper": rows.where(c == "proper")}[kind]


def sliding(grams: DataFrame, width: int = 2, k: int = 50) -> DataFrame:
    """Words that are among the k most active of a window of ``width`` half-years: windows, best, first and last."""
    active = grams.where(admissible(F.col("gram"))).groupBy("gram", dates.semester(F.col("date")).alias("sem")).agg(F.countDistinct("date").alias("days"))
    spread = active.select("gram", "days", F.explode(F.sequence(F.col("sem") - (width - 1), F.col("sem"))).alias("start"))
    held = spread.groupBy("start", "gram").agg(F.sum("days").alias("days"))
    best = held.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("days"), "gram"))).where(F.col("rank") <= k)
    out = best.groupBy("gram").agg(F.count("*").alias("windows"), F.max("days").alias("best"), F.min("start").alias("first"), F.max("start").alias("last"))
    return out.select("gram", "windows", "best", dates.semester_label(F.col("first")).alias("first"), dates.semester_label(F.col("last")).alias("last"))


def absorbed(words: DataFrame, share: float = 0.01) -> DataFrame:
    """words(media, gram, total) -> unit: spellings under a share of their key's largest join the largest one."""
    key = Window.partitionBy("media", "key")
    rows = words.withColumn("key", text.strip_accents(F.col("gram")))
    rows = rows.withColumn("most", F.max("total").over(key)).withColumn("head", F.first("gram").over(key.orderBy(F.desc("total"), "gram")))
    return rows.select("media", "gram", "total", F.when(F.col("total") < share * F.col("most"), F.col("head")).otherwise(F.col("gram")).alias("unit"))


def top_units(grams: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The k units of each media with the most active days of their summed series; exact in one pass."""
    days = grams.join(units.select("media", "gram", "unit"), ["media", "gram"]).groupBy("media", "unit").agg(F.countDistinct("date").alias("active_days"), F.sum("n").alias("total"))
    return days.withColumn("rank", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("active_days"), "unit"))).where(F.col("rank") <= k)


def matrix_long(grams: DataFrame, totals: DataFrame, words: DataFrame) -> DataFrame:
    """Dense (media, gram, pos, date, n, total): every chosen word on every day of its media; pos counts days from 0."""
    days = grid(totals)
    return words.select("media", "gram").join(F.broadcast(days), "media").join(grams, ["media", "gram", "date"], "left").select("media", "gram", "pos", "date", F.coalesce("n", F.lit(0)).alias("n"), "total")


def grid(totals: DataFrame) -> DataFrame:
    """totals(media, date, total) with pos, the day's place in its media."""
    return totals.withColumn("pos", F.row_number().over(Window.partitionBy("media").orderBy("date")) - 1)


def unified(grams: DataFrame) -> DataFrame:
    """Sums over all media by gram and day."""
    return grams.groupBy("gram", "date").agg(F.sum("n").alias("n"))


def coverage(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.countDistinct("media").alias("media_count"), F.sum("n").alias("total"))


def new_ids(known: DataFrame, words: DataFrame) -> DataFrame:
    """known(id, word), words(word) -> ids for unknown words, after the largest known id, by word."""
    fresh = words.select("word").distinct().join(known, "word", "left_anti")
    start = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    # rank within ranges of the first character, then add the sizes of the ranges before: no single-task sort
    part = fresh.withColumn("part", F.substring("word", 1, 1))
    sizes = part.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("word"))
    return part.withColumn("rank", rank).join(F.broadcast(before), "part").crossJoin(F.broadcast(start)).select((F.col("start") + F.col("before") + F.col("rank")).alias("id"), "word")
