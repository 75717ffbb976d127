"""Series of counts: calendars, rolling sums, jumps, blocks, moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .quantiles import exact

KEY = ("mot",)


def _by(keys: Sequence[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def freq(n: Column, total: Column) -> Column:
    """Occurrences per 100,000; null where the total is 0."""
    return F.lit(1e5) * n / F.nullif(total, F.lit(0))


def surprise(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def calendar(series: DataFrame, keys: Sequence[str] = KEY, values: Sequence[str] = ("x", "n_tot")) -> DataFrame:
    """Every calendar day between the first and last of each key; days without rows are 0."""
    days = series.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(series, [*keys, "date"], "left").fillna(0, list(values))


def rolling(series: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """f: frequency over the k rows that end at each date; null before k rows are there."""
    w = _by(keys).rowsBetween(-(k - 1), 0)
    full = F.count("*").over(w) == k
    return series.withColumn("f", F.when(full, freq(F.sum("x").over(w), F.sum("n_tot").over(w))))


def jumps(series: DataFrame, k: int, keys: Sequence[str] = KEY) -> DataFrame:
    """d: the rolling frequency minus that of the disjoint window before."""
    return rolling(series, k, keys).where("f is not null").withColumn("d", F.col("f") - F.lag("f", k).over(_by(keys))).where("d is not null")


def extreme_jumps(series: DataFrame, k: int, quantile: float = 0.99, most: int = 15, keys: Sequence[str] = KEY) -> DataFrame:
    d = cut(jumps(series, k, keys))
    bounds = exact(d, list(keys), "d", (quantile, 1 - quantile)).select(*keys, F.col("v")[0].alias("high"), F.col("v")[1].alias("low"))
    rows = d.join(bounds, list(keys)).withColumn("way", F.when(F.col("d") > F.col("high"), "up").when(F.col("d") < F.col("low"), "down")).where("way is not null")
    order = Window.partitionBy(*keys, "way").orderBy(F.desc(F.abs("d")), "date")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*keys, "way", "rank", "date", "d")


def moving_average(series: DataFrame, value: str, half: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    return series.withColumn("avg", F.avg(value).over(_by(keys).rowsBetween(-half, half)))


def blocks(series: DataFrame, size: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Sums over successive blocks of ``size`` rows, dated by the middle one; an unfinished last block is left out."""
    pos = series.withColumn("pos", F.row_number().over(_by(keys)) - 1).withColumn("block", F.floor(F.col("pos") / size).cast("int"))
    out = pos.groupBy(*keys, "block").agg(F.count("*").alias("rows"), F.sum("x").alias("x"), F.sum("n_tot").alias("n_tot"), F.max(F.when(F.col("pos") % size == size // 2, F.col("date"))).alias("date"))
    return out.where(F.col("rows") == size).drop("rows")


def moments(df: DataFrame, value: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Population moments; kurtosis is the excess."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.try_divide(F.var_pop(v), F.avg(v)).alias("var_mean"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and densities by bin (1..bins; 0 and bins + 1 hold what lies outside)."""
    out = df.groupBy(*keys, F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) / ((high - low) / bins))


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Ranks from 1; ties share their mean rank."""
    w = Window.partitionBy(*keys)
    return df.withColumn("avg_rank", F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def acf1(df: DataFrame, value: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Autocorrelation at lag 1."""
    rows = df.withColumn("m", F.avg(value).over(Window.partitionBy(*keys))).withColumn("before", F.lag(value).over(_by(keys)))
    dev = F.col(value) - F.col("m")
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(dev * (F.col("before") - F.col("m"))), F.sum(dev * dev)).alias("acf1"))
