"""URL queues: cleaning, filters, states, sitemaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

# fixed values: file endings and traces that no article's address has
FILES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".pdf", ".mp3", ".mp4", ".xml")
TRACES = ("image:media", "httpRequest", "%20http")


def not_article(url: Column, media: Column, excluded: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Front pages, video and podcast hosts, files, broken addresses, and segments that a media excludes."""
    bare = F.split_part(url, F.lit("?"), F.lit(1))
    host = F.regexp_extract(bare, "^[^/]*//([^/]*)", 1)
    path = F.regexp_extract(bare, "^[^/]*//[^/]*/(.*)$", 1)
    low = F.rtrim(F.lower(bare), F.lit("/"))
    bad = (F.trim(path, F.lit("/")) == "") | host.rlike(r"^(video|podcasts)\.")
    for e in FILES:
        bad = bad | low.endswith(e)
    for x in TRACES:
        bad = bad | url.contains(x)
    for name, segments in (excluded or {}).items():
        for s in segments:
            bad = bad | ((media == name) & bare.contains(s))
    return bad


def clean(url: Column) -> Column:
    """Without query and fragment, https, no :80 port."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^http://", "https://"), "^(https://[^/:]+):80(/|$)", "$1$2")


def article_of(fields: Column) -> Column:
    """The last field of a row that starts with http, trimmed; null if none does."""
    return F.try_element_at(F.filter(F.transform(fields, lambda f: F.trim(f)), lambda f: f.startswith("http")), F.lit(-1))


def locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))


def sub_sitemaps(xml: Column) -> Column:
    """(loc, lastmod) of the <sitemap> blocks of an index; lastmod is cut to the day."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<sitemap>(.*?)</sitemap>"), F.lit(1))
    return F.transform(
        blocks, lambda b: F.struct(F.regexp_extract(b, r"<loc>\s*([^<]*?)\s*</loc>", 1).alias("loc"), F.nullif(F.substring(F.regexp_extract(b, r"<lastmod>\s*([^<]*?)\s*</lastmod>", 1), 1, 10), F.lit("")).alias("lastmod"))
    )


def may_cover(loc: Column, lastmod: Column, bound: str) -> Column:
    """Whether a sub-sitemap can hold articles from the month ``bound`` on: by lastmod, else by a date in its address, else yes."""
    month = F.nullif(F.regexp_replace(F.regexp_extract(loc, r"(20\d{2}[-_/]\d{2})", 1), "[_/]", "-"), F.lit(""))
    return F.coalesce(F.substring(lastmod, 1, 7), month, F.lit("9999")) >= bound


def state_after(attempts: DataFrame) -> DataFrame:
    """attempts(id, at, ok), in order -> the state: 2 once one worked; else 1 after one failure, 4 after two or more."""
    s = attempts.groupBy("id").agg(F.max(F.col("ok").cast("int")).alias("good"), F.count("*").alias("tries"))
    return s.select("id", F.when(F.col("good") == 1, 2).when(F.col("tries") >= 2, 4).otherwise(1).alias("state"))


def next_urls(queue: DataFrame) -> DataFrame:
    """One url of each media: new ones before failed ones, by id."""
    w = Window.partitionBy("media").orderBy("state", "id")
    return queue.where(F.col("state").isin(0, 1)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def tree(edges: DataFrame, roots: DataFrame, bound: str, depth: int | None = None) -> DataFrame:
    """(node, depth): breadth-first expansion of a sitemap index, edges(parent, child, lastmod), pruned by ``may_cover``.

    A level at a time, until one brings nothing new or ``depth`` levels are there. Nodes that were seen aren't gone
    through again, so cycles end and a shared child has its least depth; each level is checkpointed.
    """
    kept = cut(edges.where(may_cover(F.col("child"), F.col("lastmod"), bound)).select("parent", "child"))
    level = seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    d = 1
    while depth is None or d < depth:
        found = kept.join(level, kept.parent == level.node, "left_semi").select(F.col("child").alias("node")).distinct()
        level = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if level.limit(1).count() == 0:
            break
        seen = seen.unionByName(level)
        d += 1
    return seen


def append_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target doesn't have, each once; what an appending writer adds."""
    return rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")
