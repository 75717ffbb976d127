"""Windows around positions of a series, and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_long(centres: DataFrame, grid: DataFrame, half: int, value: str = "f") -> DataFrame:
    """centres(mot, pos), grid(mot, pos, value) -> (mot, centre, j, value): an equi-join on exploded offsets.

    Centres whose window leaves the grid are dropped.
    """
    rows = centres.select("mot", F.col("pos").alias("centre"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("j"))
    rows = rows.withColumn("pos", F.col("centre") + F.col("j")).join(grid.select("mot", "pos", value), ["mot", "pos"])
    full = F.count("*").over(Window.partitionBy("mot", "centre")) == 2 * half + 1
    return rows.withColumn("full", full).where("full").select("mot", "centre", "j", value)


def windows_array(grid: DataFrame, half: int, value: str = "f") -> DataFrame:
    """Every full window of a dense grid as an array ``w``, by one ordered frame: no self-join."""
    frame = Window.partitionBy("mot").orderBy("pos").rowsBetween(-half, half)
    rows = grid.withColumn("w", F.collect_list(value).over(frame))
    return rows.where(F.size("w") == 2 * half + 1)


def mean_of(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / F.size(w)


def std_of(w: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(w))


def z_scores(df: DataFrame, column: str = "w") -> DataFrame:
    """Each window minus its mean over its population deviation; flat windows are dropped."""
    rows = df.withColumn("m", mean_of(F.col(column))).withColumn("s", std_of(F.col(column), F.col("m"))).where("s > 0")
    return rows.withColumn(column, F.transform(column, lambda x: (x - F.col("m")) / F.col("s"))).drop("m", "s")


def min_max(df: DataFrame, column: str = "w") -> DataFrame:
    rows = df.withColumn("lo", F.array_min(column)).withColumn("hi", F.array_max(column)).where("hi > lo")
    return rows.withColumn(column, F.transform(column, lambda x: (x - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def column_scores(long: DataFrame, value: str = "f") -> DataFrame:
    """Each place j standardised over all windows (a control: it destroys the shape of single windows)."""
    by_j = long.groupBy("j").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return long.join(F.broadcast(by_j), "j").withColumn(value, F.try_divide(F.col(value) - F.col("m"), F.col("s"))).drop("m", "s")


def interpolate_thin(long: DataFrame, floor: int, value: str = "f") -> DataFrame:
    """long(mot, centre, j, n_tot, value): days under ``floor`` get a value between their nearest full days.

    At the ends of a window the nearest full day's value holds; windows whose centre is thin are dropped.
    """
    key = Window.partitionBy("mot", "centre")
    good = F.col("n_tot") >= floor
    rows = long.withColumn("ok", F.max((good & (F.col("j") == 0)).cast("int")).over(key)).where("ok = 1")
    before = key.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    after = key.orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    for name, column in (("v", F.col(value)), ("k", F.col("j"))):
        rows = rows.withColumn(f"{name}0", F.last(F.when(good, column), True).over(before)).withColumn(f"{name}1", F.first(F.when(good, column), True).over(after))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * F.try_divide((F.col("j") - F.col("k0")).cast("double"), F.col("k1") - F.col("k0"))
    new = F.when(good, F.col(value)).otherwise(F.coalesce(between, "v0", "v1"))
    return rows.select("mot", "centre", "j", new.alias(value), (~good).alias("thin"))


def roll(array: Column, by: Column) -> Column:
    """The array turned to the right by ``by`` places."""
    n = F.size(array)
    k = F.pmod(by, n).cast("int")
    return F.concat(F.slice(array, n - k + 1, F.greatest(k, F.lit(0))), F.slice(array, F.lit(1), n - k))


def asymmetry(w: Column, half: int) -> Column:
    """Mean after the centre minus mean before it."""
    part = lambda a: F.aggregate(F.slice(w, a, half), F.lit(0.0), lambda s, x: s + x) / half
    return part(half + 2) - part(1)


def profile_shape(w: Column, half: int) -> list[Column]:
    """Sign changes, share of energy near the centre, signs of the means before and after."""
    n, near = 2 * half + 1, (2 * half + 1) // 8
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)
    mid = F.aggregate(F.slice(w, half + 1 - near, 2 * near + 1), F.lit(0.0), lambda s, x: s + x * x)
    changes = F.size(F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.signum(F.get(w, i)) != F.signum(F.get(w, i - 1))))
    side = lambda a: F.signum(F.aggregate(F.slice(w, a, half), F.lit(0.0), lambda s, x: s + x))
    return [changes.cast("long").alias("changes"), F.try_divide(mid, total).alias("centre_energy"), side(1).alias("sign_before"), side(half + 2).alias("sign_after")]
