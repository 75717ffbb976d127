"""Quality rules whose cutoffs are chosen with a guarantee on false rejections.

Each rule compares a share (symbols a word, repeated words, repeated lines, capitals, marks) with a cutoff. Cutoffs
come from labelled documents; texts that are equal count once. They are dealt into three folds by a hash of the text:

* On the first, cutoffs of a fixed grid get their order of merit: what a cutoff rejects of bad and of good documents.
* On the second, the holdout, cutoffs are certified. For each stratum (language) and rule the grid is tested from the
  loosest cutoff to stricter ones; one is certified while the exact (Clopper-Pearson) upper bound on the share of good
  documents that it rejects stays under ``ALPHA / number of rules``. A sequence stops at its first failure and needs no
  correction within; each runs at ``DELTA / (strata * rules)`` (Bonferroni). So with probability ``1 - DELTA`` all
  certified cutoffs hold together, and in each stratum the rules together reject at most a share ``ALPHA`` of the good
  documents. Of the certified cutoffs the one of most merit on the first fold is used.
* The third takes no part. ``audit`` measures the false rejections on it.

A stratum with too few labelled documents gets no cutoff, so nothing is rejected there but by the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import lgamma, log
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_join, stored, text_slices

ALPHA = 0.1
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A good document that is rejected weighs as much as this share of the bad ones, when a certified cutoff is picked.
GOOD_WEIGHT = 10
#: Cutoffs that are tried, strictest first; a document is rejected where the value exceeds the cutoff.
GRID = tuple(round(0.01 * 1.2**k, 4) for k in range(32))
#: Folds of the labelled documents, by hash of the text: merit, certification, audit.
FOLDS = 3

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?"
_FIELDS = [("doc_id", pa.int64()), ("stratum", pa.string()), ("digest", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"))]
METRICS = "doc_id long, stratum string, " + ", ".join(f"{n} long" for n, _ in _FIELDS[2:])  # digest: a hash of the text


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    key = ids[: len(ids) - width + 1]
    for k in range(1, width):  # rank after each word, so that keys stay small whatever the vocabulary
        key = np.unique(key * len(seen) + ids[k : len(ids) - width + 1 + k], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[twice + k] = True
    return int(covered.sum())


def metrics_of(data: bytes) -> tuple[int, ...]:
    """The counts of METRICS, after doc_id, stratum and digest, of one text in UTF-8."""
    words = data.split()
    bare = data.translate(None, _SPACE)
    lines = [line for line in data.split(b"\n") if line.strip()]
    points = len(bare) - int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) == 0x80))
    return (
        len(words),
        points,
        len(bare) - len(bare.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(bare) - len(bare.translate(None, _CAPITALS)),
        len(bare) - len(bare.translate(None, _MARKS)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            rows = [metrics_of(t.as_buffer().to_pybytes()) if t.is_valid else (0,) * 8 for t in batch.column("text").cast(pa.binary())]
            columns = np.array(rows, np.int64).reshape(-1, 8).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), batch.column("digest"), *map(pa.array, columns)], schema=pa.schema(_FIELDS))


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs(doc_id, text, <stratum>, ...) -> METRICS, one row for each row; a null text has no words."""
    return docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64("text").alias("digest")).mapInArrow(_measure, METRICS)


RULES = ("symbols", "repeats", "dup_lines", "capitals", "marks")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _rules() -> dict[str, Column]:
    return {"symbols": _share("n_symbols", "n_words"), "repeats": _share("n_repeat_words", "n_words"), "dup_lines": _share("n_dup_lines", "n_lines"), "capitals": _share("n_capitals", "word_chars"), "marks": _share("n_marks", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p under which k or fewer of n has probability delta or more."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = np.array([lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) for x in i])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = choose + i * log(p) + (n - i) * np.log1p(-p) if p < 1 else np.full(k + 1, -np.inf)
        top = terms.max()
        under = top > -np.inf and top + np.log(np.exp(terms - top).sum()) >= log(delta)
        low, high = (p, high) if under else (low, p)
    return high


def trials(metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, fold, good, above_<rule>...): one row for each labelled text of a stratum that the base rules pass.

    Equal texts, and rows that repeat a document, are one trial, which is good only if all of its labels say so; null
    labels are left out. above_<rule> is the number of cutoffs of the grid that the value exceeds.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    above = {name: sum((F.when(value > c, 1).otherwise(0) for c in GRID), F.lit(0)) for name, value in _rules().items()}
    held = metrics.where(~base_failed()).join(known, "doc_id").select("stratum", "digest", "quality", *[n.alias(f"above_{name}") for name, n in above.items()])
    texts = held.groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), *[F.max(f"above_{name}").alias(f"above_{name}") for name in RULES])
    return texts.select("stratum", F.pmod(F.xxhash64("digest", F.lit(FOLDS)), F.lit(FOLDS)).alias("fold"), (F.col("quality") == 1).alias("good"), *[f"above_{name}" for name in RULES])


def _picked(alpha: float, sequences: int, delta: float):
    """Histograms of one (stratum, rule) -> its cutoff, if any is certified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                # documents that exceed each cutoff: good and bad on the first fold, good on the holdout
                bad, good, sure = (np.cumsum(np.array(r[c])[::-1])[::-1][1:] for c in ("bad", "good", "sure"))
                all_bad, all_good, n = (int(np.sum(r[c])) for c in ("bad", "good", "sure"))
                picked, best = None, 0.0
                for k in range(len(GRID) - 1, -1, -1):
                    if not n or sure[k] > alpha * n or upper_bound(int(sure[k]), n, delta / sequences) > alpha:
                        break
                    merit = bad[k] / max(1, all_bad) - GOOD_WEIGHT * good[k] / max(1, all_good)
                    if merit > best:
                        picked, best = GRID[k], merit
                if picked is not None:
                    rows.append((r["stratum"], r["rule"], picked))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], ["stratum", "rule", "cutoff"])

    return run


def cutoffs(tried: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from what ``trials`` gives; made where the counts are, whatever the number of strata."""
    steps = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"above_{name}").alias("above")) for name in RULES])).alias("s")
    cells = tried.where("fold < 2").select("stratum", "fold", "good", steps).groupBy("stratum", "s.rule", "s.above").agg(
        F.count_if((F.col("fold") == 0) & ~F.col("good")).alias("bad"), F.count_if((F.col("fold") == 0) & F.col("good")).alias("good"), F.count_if((F.col("fold") == 1) & F.col("good")).alias("sure")
    )

    def by_step(count: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(GRID))), lambda i: F.coalesce(F.col("m")[i][count], F.lit(0).cast("long"))).alias(count)

    rows = cells.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("above", F.struct("bad", "good", "sure")))).alias("m")).select("stratum", "rule", *map(by_step, ("bad", "good", "sure")))
    rows = cut(rows)
    return cut(rows.mapInArrow(_picked(alpha / len(RULES), max(1, rows.count()), delta), "stratum string, rule string, cutoff double"))


def audit(tried: DataFrame, found: DataFrame) -> DataFrame:
    """(stratum, good, rejected): of the good documents of the third fold, how many the cutoffs reject."""
    per = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    grid = F.array(*map(F.lit, GRID))
    # a value that exceeds k + 1 cutoffs or more exceeds the cutoff at place k
    fails = [F.coalesce(F.col(f"above_{name}") >= F.array_position(grid, F.col("cutoffs")[name]), F.lit(False)) for name in RULES]
    out = sized_join(tried.where("fold = 2 and good"), per, "stratum", "left")
    return out.groupBy("stratum").agg(F.count("*").alias("good"), F.count_if(reduce(or_, fails)).alias("rejected"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs(doc_id, text, <stratum>, ...), labels(doc_id, quality) -> METRICS, base_failed, failed_rules, kept.

    One row for each row of docs, also for those that repeat a doc_id. Empty and null texts fail the base rules; texts
    of any length are whole. Without labels only the base rules count. Other columns, whatever their names, are
    ignored; no rows give no rows.
    """
    metrics = stored(measure(docs, stratum))
    found = cutoffs(trials(metrics, labels))
    per = cut(found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    judged = sized_join(metrics, per, "stratum", "left")
    rules = F.array_compact(F.array(*[F.when(value > F.col("cutoffs")[name], F.lit(name)) for name, value in _rules().items()]))
    judged = judged.select(*metrics.columns, base_failed().alias("base_failed"), rules.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
