"""Counting n-grams by day, and the store that queries read: grams(media, gram, date, n), totals(media, date, total)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def sentence_tokens(articles: DataFrame, *keep: str) -> DataFrame:
    """articles(..., contenu) -> keep..., tokens: one row for each sentence that has a token.

    The split makes rows before tokens are extracted, so the extraction runs once for each sentence.
    """
    parts = articles.select(*keep, F.explode(text.sentences(F.col("contenu"))).alias("sentence"))
    return parts.select(*keep, F.regexp_extract_all("sentence", F.lit(text.TOKEN), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)


def grams_of(tokens: Column, size: int) -> Column:
    """Array of the n-grams of a token array, each joined by spaces."""
    if size == 1:
        return tokens
    at = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, size), " "))


def counts(articles: DataFrame, size: int = 1, keys: Sequence[str] = ("media", "date")) -> DataFrame:
    """articles(keys..., contenu) -> keys..., gram, n. Map-side partial sums go before the one shuffle.

    Rows without a key or a text are left out. The filters are there for the planner too: joins would infer them on
    one side only, and two uses of the same counts would no longer share their shuffle.
    """
    rows = articles
    for k in (*keys, "contenu"):
        rows = rows.where(F.col(k).isNotNull())
    parts = rows.select(*keys, F.explode(text.sentences(F.col("contenu"))).alias("sentence"))
    tokens = F.regexp_extract_all("sentence", F.lit(text.TOKEN), F.lit(0))
    if size > 1:
        # exploding an array of one keeps the planner from inlining the extraction into the lambda below
        parts = parts.select(*keys, F.explode(F.array(tokens)).alias("tokens"))
        tokens = grams_of(F.col("tokens"), size)
    grams = parts.select(*keys, F.explode(tokens).alias("gram")).where(F.col("gram").isNotNull())
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def daily_totals(grams: DataFrame, keys: Sequence[str] = ("media", "date")) -> DataFrame:
    return grams.groupBy(*keys).agg(F.sum("n").alias("total"))


def min_total(grams: DataFrame, above: int = 10, keys: Sequence[str] = ("media", "gram")) -> DataFrame:
    """Grams whose total is over ``above``: one shuffle by gram serves the sum and the filter."""
    return grams.withColumn("all_n", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("all_n") > above).drop("all_n")


def top(grams: DataFrame, resolution: str, k: int = 500, stop: Sequence[str] = text.STOP_WORDS) -> DataFrame:
    """The k most frequent grams of each period; ties go by gram. The rank limit runs before the shuffle."""
    sums = grams.groupBy("media", dates.period(F.col("date"), resolution).alias("period"), "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("media", "period").orderBy(F.desc("n"), "gram")
    ranked = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("stop", text.stop_flag(F.split("gram", " "), stop))


def top_query(top: DataFrame, media: str, period: int, k: int = 10, no_stop: bool = True) -> DataFrame:
    """The stored ranks of a period; stop grams are left out after ranking, so fewer than k may come."""
    rows = top.where((F.col("media") == media) & (F.col("period") == period))
    rows = rows.where(~F.col("stop")) if no_stop else rows
    return rows.orderBy("rank").limit(min(k, 500)).select("gram", "n")


def evolution(top: DataFrame, totals: DataFrame, resolution: str, before: int, after: int, k: int = 10, no_stop: bool = True) -> DataFrame:
    """Rises and falls of frequency (per 100,000) between two periods, from the stored ranks of one media."""

    def side(period: int, name: str) -> DataFrame:
        low, high = dates.period_bounds(F.lit(period), F.lit(resolution))
        total = totals.where(F.col("date").between(low, high)).agg(F.sum("total").alias("total"))
        rows = top.where(F.col("period") == period)
        rows = rows.where(~F.col("stop")) if no_stop else rows
        return rows.crossJoin(F.broadcast(total)).select("gram", (F.col("n") / F.col("total") * 1e5).alias(name))

    both = side(before, "before").join(side(after, "after"), "gram", "full_outer").fillna(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    up = both.where("delta > 0").orderBy(F.desc("delta"), "gram").limit(min(k, 100)).withColumn("way", F.lit("up"))
    down = both.where("delta < 0").orderBy("delta", "gram").limit(min(k, 100)).withColumn("way", F.lit("down"))
    return up.unionByName(down).select("way", "gram", "before", "after", "delta")


def series(grams: DataFrame, totals: DataFrame, wanted: Sequence[str], low: int = 19000101, high: int = 21001231) -> DataFrame:
    """(media, gram, date, n, total) for each wanted gram and each day that has a total; absent days are 0.

    Wanted grams are picked by a join, so that totals and counts of the same articles share one shuffle; filter a
    stored table of grams before.
    """
    days = totals.where(F.col("date").between(low, high))
    names = F.broadcast(days.sparkSession.createDataFrame([(w,) for w in wanted], "gram string"))
    found = grams.where(F.col("date").between(low, high)).join(names, "gram")
    return days.crossJoin(names).join(found, ["media", "gram", "date"], "left").select("media", "gram", "date", F.coalesce("n", F.lit(0)).alias("n"), "total")


def rolled_up(series: DataFrame, resolution: str) -> DataFrame:
    """Sums of n and total by year, year and month, or day."""
    parts = [dates.year(F.col("date")).alias("year"), dates.month(F.col("date")).alias("month"), (F.col("date") % 100).cast("int").alias("day")]
    return series.groupBy("media", "gram", *parts[: {"year": 1, "month": 2, "day": 3}[resolution]]).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def tokenised(words: Sequence[str]) -> list[str]:
    """Query expressions as grams; each must have 1 to 3 words."""
    import re

    out = []
    for w in words:
        found = re.findall(text.TOKEN, re.sub(r"(?<=[A-Z])\.", "", w).lower().replace("’", "'"))
        if not 1 <= len(found) <= 3:
            raise ValueError(f"{w.strip()!r}: 1 to 3 words expected")
        out.append(" ".join(found))
    return out


def variants(grams: DataFrame, word: str) -> DataFrame:
    """Daily sums of all spellings of a word that are equal without accents."""
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c.isascii())
    return grams.where(F.col("gram").isin(word.lower(), bare)).groupBy("media", "date").agg(F.sum("n").alias("n"))
