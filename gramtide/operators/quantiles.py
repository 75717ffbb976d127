"""Exact quantiles by narrowing the range that holds a rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, sized_join

#: Bins of a pass, and values in a range from which on it is sorted.
BINS, FEW = 256, 8192


def exact(df: DataFrame, keys: Sequence[str], value: str | Column, qs: Sequence[float], few: int = FEW) -> DataFrame:
    """(keys..., v): quantiles of each group in the order of ``qs``, with linear interpolation between ranks.

    Each pass counts the values of a range in BINS bins and goes on with the bin that holds the rank, between the least
    and the greatest value found there; a range of few values, or of one that repeats, ends it. So no task holds a
    group's values: at most ``few`` of them are ranked. Null values don't count; a group without others has no row.
    Null keys are a group like any other.
    """
    value = F.col(value) if isinstance(value, str) else value
    group = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    rows = cut(df.select(*keys, group.alias("__g"), value.cast("double").alias("__v")).where("__v is not null"))
    facts = cut(rows.groupBy("__g", *keys).agg(F.count("*").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    place = [F.lit(float(q)) * (F.col("__n") - 1) for q in qs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    # rank: from 0, in the range lo ... hi that holds ``inside`` values and has ``before`` values below it
    open_ = cut(facts.select("__g", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("__n").alias("inside")))
    done = None
    while True:
        ready = open_.where((F.col("inside") <= few) | (F.col("lo") == F.col("hi")))
        done = ready if done is None else done.unionByName(ready)
        open_ = open_.where((F.col("inside") > few) & (F.col("lo") < F.col("hi")))
        if open_.limit(1).count() == 0:
            break
        here = sized_join(rows.select("__g", "__v"), open_, "__g").where(F.col("__v").between(F.col("lo"), F.col("hi")))
        at = F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
        bins = here.groupBy("__g", "rank", "before", at.alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        below = F.sum("inside").over(Window.partitionBy("__g", "rank").orderBy("bin")) - F.col("inside")
        held = bins.withColumn("before", F.col("before") + below).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("inside")))
        open_ = cut(held.select("__g", "rank", "lo", "hi", "before", "inside"))
    last = sized_join(rows.select("__g", "__v"), cut(done), "__g").where(F.col("__v").between(F.col("lo"), F.col("hi")))
    values = last.groupBy("__g", "rank", "before", "__v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("__g", "rank").orderBy("__v"))
    found = values.withColumn("upto", upto).where(F.col("rank") < F.col("upto")).groupBy("__g", "rank").agg(F.min("__v").alias("__v"))
    of = found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank"), F.col("__v")))).alias("__of"))

    def one(p: Column) -> Column:
        low, high = F.element_at("__of", F.floor(p)), F.element_at("__of", F.ceil(p))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return sized_join(facts, of, "__g").select(*keys, F.array(*[one(p) for p in place]).alias("v"))
