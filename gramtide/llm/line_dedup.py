"""Line deduplication: lines that spread over many sites are boilerplate and go.

The spread of a line is the number of distinct sites that have it. A HyperLogLog sketch for each line hash, merged by
aggregation, estimates it; lines whose estimate lies near the threshold get an exact distinct count. Built from
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Sites from which a line is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this share of the threshold (six standard errors) are counted exactly.
MARGIN = 0.2
#: Hashes of boilerplate lines up to which they are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _hash(line: Column) -> Column:
    """128 bits: two hashes of the line, neither of which follows from the other."""
    # a hash of several columns feeds each into the next: the constant comes first, so that the line is hashed anew
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def _key(text: Column) -> Column:
    """With the doc_id it tells rows apart, also those that repeat one or have none."""
    return F.struct(F.xxhash64(text).alias("x"), F.octet_length(text).alias("n"))


def _blank(line: Column) -> Column:
    """Nothing but ASCII white space."""
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, key, site, place, h): every line that isn't blank (nothing but ASCII white space)."""
    # the key is taken before lines are: above them it would be taken, and the text carried, for each line
    whole = docs.select("doc_id", _key(F.col("text")).alias("key"), F.col(site).cast("string").alias("site"), F.split("text", "\n").alias("lines"))
    rows = whole.select("doc_id", "key", "site", F.posexplode("lines").alias("place", "line"))
    return rows.where(~_blank(F.col("line"))).select("doc_id", "key", "site", "place", _hash(F.col("line")).alias("h"))


def _without(lines: Column, gone: Column) -> Column:
    """An array without the sorted places ``gone``: the slices between them, so a text of any length is walked once."""
    after = lambda k: F.coalesce(F.get(gone, k - 1) + 1, F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, after(k) + 1, F.coalesce(F.get(gone, k), F.size(lines)) - after(k))))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs(doc_id, text, <site>, ...) -> (h): hashes of the lines on min_sites or more distinct sites.

    A null site counts as no site.
    """
    lines = _lines(docs, site)
    # one sketch for each line hash; a line on fewer places than the threshold can't spread over as many sites
    sketches = lines.groupBy("h").agg(F.count("site").alias("places"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).where(F.col("places") >= min_sites)
    spread = cut(sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN)))
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("h")
    near = F.broadcast(near) if small_enough(near, BROADCAST_ROWS) else near
    exact = lines.join(near, "h").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("h").unionByName(exact.select("h")))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs(doc_id, text, <site>, ...) -> its columns with ``text`` cleaned, and n_lines, n_removed_lines (long).

    Blank lines stay (spaces, tabs and carriage returns are blank); lines are compared as they are, so a repeated line
    counts once for a site; what remains is joined by newlines again. A null text stays null with no lines, an empty
    one has one line. Every row stays, also one whose lines are all boilerplate (its text is then empty) and rows that
    repeat a doc_id. Texts of any length are whole. Columns n_lines and n_removed_lines of docs give way to the new
    ones; all others stay as they are. No rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    found = boilerplate(docs, site, min_sites)
    found = F.broadcast(found) if small_enough(found, BROADCAST_ROWS) else found
    hits = _lines(docs, site).join(found, "h", "left_semi")
    held = cut(hits.groupBy(F.col("doc_id").alias("__held_by"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_set("place")).alias("__gone")))
    # documents are always shuffled to their lines: this side grows with them, so it is never broadcast
    lines = F.split("text", "\n")
    joined = docs.select(*names).join(held, F.col("doc_id").eqNullSafe(F.col("__held_by")) & (_key(F.col("text")) == F.col("__key")), "left")
    # the lines are bound once, not split again for each slice
    stay = F.transform(F.array(lines), lambda x: _without(x, F.col("__gone")))[0]
    out = joined.select(*names, F.when(F.col("__gone").isNotNull(), stay).alias("__stay"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"))
    removed = F.when(F.col("__stay").isNotNull(), F.col("n_lines") - F.size("__stay")).otherwise(F.lit(0)).cast("long")
    cleaned = F.when(F.col("__stay").isNotNull(), F.array_join("__stay", "\n")).otherwise(F.col("text"))
    return out.select(*[cleaned.alias("text") if c == "text" else F.col(c) for c in names], F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), removed.alias("n_removed_lines"))
