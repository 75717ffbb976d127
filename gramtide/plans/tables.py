"""The test tables under the names that the operators know."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ngrams, vocab

#: Test documents come as one file with one row group; texts are dealt over tasks before they are tokenised.
DEAL_BYTES = 1 << 22


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict = {}

    def once(self, name, make):
        """What ``make`` gives, made at the first call for the name."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def articles(self) -> DataFrame:
        """(id, media, section, date, contenu): languages as media (null: ``unknown``), sources as sections, 120 days."""
        d = self.raw("documents")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int"))
        return d.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("unknown")).alias("media"), F.col("source").alias("section"), dates.day_number(day).alias("date"), F.col("text").alias("contenu"))

    @cached_property
    def dealt(self) -> DataFrame:
        """Articles over as many tasks as there are cores where the table is fewer files than that."""
        cores = self.spark.sparkContext.defaultParallelism
        few = self.articles.rdd.getNumPartitions() < cores
        return self.articles.repartition(cores) if few else self.articles

    @cached_property
    def uni(self) -> DataFrame:
        return ngrams.counts(self.dealt, 1)

    @cached_property
    def bi(self) -> DataFrame:
        return ngrams.counts(self.dealt, 2)

    @cached_property
    def tri(self) -> DataFrame:
        return ngrams.counts(self.dealt, 3)

    @cached_property
    def totals(self) -> DataFrame:
        return ngrams.daily_totals(self.uni)

    @cached_property
    def census(self) -> DataFrame:
        return vocab.census(self.uni)

    @cached_property
    def brands(self) -> DataFrame:
        """(mot, date, x): orders of a brand's parts shipped on a day."""
        part = self.raw("part").select("p_partkey", "p_brand")
        rows = self.raw("lineitem").select("l_partkey", "l_shipdate").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy(F.col("p_brand").alias("mot"), F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("x"))

    @cached_property
    def brand_totals(self) -> DataFrame:
        return self.brands.groupBy("date").agg(F.sum("x").alias("n_tot"))

    @cached_property
    def series(self) -> DataFrame:
        """(mot, date, x, n_tot): dense, absent days are 0."""
        words = self.brands.select("mot").distinct()
        return words.crossJoin(F.broadcast(self.brand_totals)).join(self.brands, ["mot", "date"], "left").select("mot", "date", F.coalesce("x", F.lit(0)).alias("x"), "n_tot")

    @cached_property
    def snapshots(self) -> DataFrame:
        """(media, ts, event_id, ok, bad): cumulative counters.

        Sums by hour first, then a running sum over hours, then one within each hour: no task sorts a medium.
        """
        even = F.floor("value") % 2 == 0
        rows = self.raw("events").select(F.col("event_type").alias("media"), "ts", "event_id", even.cast("long").alias("ok"), (~even).cast("long").alias("bad"), F.date_trunc("hour", "ts").alias("hour"))
        before = Window.partitionBy("media").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        hours = rows.groupBy("media", "hour").agg(F.sum("ok").alias("ok_h"), F.sum("bad").alias("bad_h"))
        hours = hours.select("media", "hour", *[F.coalesce(F.sum(f"{c}_h").over(before), F.lit(0)).alias(f"{c}_before") for c in ("ok", "bad")])
        within = Window.partitionBy("media", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        summed = rows.join(hours, ["media", "hour"])
        return summed.select("media", "ts", "event_id", *[(F.col(f"{c}_before") + F.sum(c).over(within)).alias(c) for c in ("ok", "bad")])

    @cached_property
    def queue(self) -> DataFrame:
        """(id, media, url, state)."""
        return self.raw("pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("media"), "url", (F.col("page_id") % 6).cast("int").alias("state"))
