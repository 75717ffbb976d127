"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts earlier in the corpus.

``doubled`` is the method as it stands: Spark sorts the pairs of ranks of all places at growing offsets and reranks
until a place is unique or the rank tells 100 bytes. It moves tens of bytes for each byte in each of eight rounds.

``remove_repeats`` gives the same with fewer places and fewer rounds. Ranks are 64-bit hashes that double in length (the
rank of 2 L bytes is made of the ranks of the L bytes at offsets 0 and L), so lengths under 32 need no sort:

1. Level 32. Every window is filed under one of its 32-byte strings, that with the least rank (the last of equals),
   which depends on the window's bytes only. Windows in a row that share it form a run; the corpus has about one run
   for 30 bytes. Spark sorts (rank of the string, rank of the run's bytes, place). A run whose string occurs nowhere
   else is unique and done. A run whose bytes all occur in an earlier run is repeated as a whole and done (within the
   texts of a slice this is seen before anything is shuffled, so neither periodic texts nor passages that very many
   texts share make a crowd).
2. Level 100, the threshold. Of the runs that share their string with different ones the bytes are sorted by string,
   and the windows of each get their rank from the pair of ranks of 64 bytes at offsets 0 and 36. A window whose rank
   has an earlier place is repeated. Where very many different runs share a string, single windows are sorted by
   (string, rank) instead, so that no task has to hold such a group.

A window is told by two 64-bit ranks, its string's and its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_slices

LENGTH = 100
BASE = 32
#: Windows of a document that are worked on at once.
SEGMENT = 1 << 19
#: Different runs of one string beyond which its windows are sorted one by one.
MANY_RUNS = 2000

_ONE = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 20) - 1)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of a string from the ranks of two parts that cover it."""
    x = left * _A
    x ^= x >> np.uint64(29)
    x += right
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def _ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all strings of BASE bytes, and of all windows."""
    n, rank, length, base = len(data), _ONE[data], 1, None
    while length < 64:
        rank = _pair(rank[: len(rank) - length], rank[length:])
        length *= 2
        if length == BASE:
            base = rank
    return base, _pair(rank[: n - LENGTH + 1], rank[LENGTH - 64 : n - 63])


def _window_ranks(data: np.ndarray) -> np.ndarray:
    return _ranks(data)[1]


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the string, rank of the run's bytes, first window, number of windows) of the runs of a byte array."""
    base, windows = _ranks(data)
    span = LENGTH - BASE + 1
    least = (base & ~_PLACE) | (_PLACE - np.arange(len(base), dtype=np.uint64))
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(windows)
    least = np.minimum(least[:n], least[span - width : span - width + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, n))
    at = (_PLACE - (least[first] & _PLACE)).astype(np.int64)
    # the first and the last window of a run overlap, so their ranks tell all of its bytes
    return base[at], _pair(windows[first], windows[first + size - 1]) + size.astype(np.uint64), first, size


_FILED = pa.schema([("doc_id", pa.int64()), ("string", pa.int64()), ("whole", pa.int64()), ("run", pa.int64()), ("upto", pa.int64())])


def _own_repeats(string: np.ndarray, run: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs to file, begins, ends): later runs of a text that equal one of its own earlier runs are repeated without
    asking the corpus; successive ones are one stretch. Periodic texts have a run for each period otherwise."""
    _, at, which = np.unique(run, return_index=True, return_inverse=True)
    later = np.flatnonzero((at[which] != np.arange(len(run))) & (string == string[at[which]]))
    if not len(later):
        return np.arange(len(run)), later, later
    begin, end = first[later], first[later] + size[later]
    new = np.concatenate([[True], begin[1:] != end[:-1]])
    return np.setdiff1d(np.arange(len(run)), later), begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _first_of_each(string: np.ndarray, whole: np.ndarray, places: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(runs to file, runs that are repeated) of the runs of many texts: of equal runs the one at the least place, given
    as arrays from the first to the last that decides, is filed for all. Others at that very place count as filed."""
    both = string * _A ^ whole
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return np.arange(len(string)), same
    many = np.unique(np.concatenate([order[same], order[same + 1]]))  # runs that have an equal, or a hash alike
    order = many[np.lexsort((*(p[many] for p in places[::-1]), whole[many], string[many]))]
    head = np.concatenate([[True], (string[order[1:]] != string[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])])
    least = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    there = np.logical_and.reduce([p[order] == p[least] for p in places])
    file = np.ones(len(string), bool)
    file[order[~head]] = False
    return np.flatnonzero(file), np.sort(order[~there])


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the texts, as (string, whole, run); stretches that are repeated for sure, as (run, upto) = (a, b).

    What a text repeats of itself, and what the texts at hand repeat of each other, is settled here: of a passage that
    very many texts share, a slice of texts files one run for each place in the passage.
    """
    for whole in batches:
        for batch in text_slices(whole):
            rows, columns, known = [], ([], [], [], [], []), ([], [], [])
            texts = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                if not texts[k].is_valid:
                    continue
                data = np.frombuffer(texts[k].as_buffer(), np.uint8)
                for at in range(0, len(data) - LENGTH + 1, SEGMENT):
                    string, run, first, size = _runs(data[at : at + SEGMENT + LENGTH - 1])
                    filed, a, b = _own_repeats(string, run, first, size)
                    rows.append(np.full(len(filed), k))
                    for column, values in zip(columns, (string[filed], run[filed], first[filed] + at, size[filed]), strict=False):
                        column.append(values)
                    for column, values in zip(known, (np.full(len(a), k), a + at, b + at), strict=True):
                        column.append(values)
            if not rows:
                continue
            doc = batch.column("doc_id")
            row, string, run, first, size = (np.concatenate(c) for c in (rows, *columns[:4]))
            valid, ids = np.asarray(doc.is_valid()), np.asarray(doc.fill_null(0))
            filed, repeated = _first_of_each(string, run, (valid[row], ids[row], first))
            # repeated runs that follow each other in a text are one stretch
            order = repeated[np.lexsort((first[repeated], row[repeated]))]
            begin, end = first[order], first[order] + size[order]
            new = np.concatenate([[True], (row[order[1:]] != row[order[:-1]]) | (begin[1:] != end[:-1])]) if len(order) else np.zeros(0, bool)
            last = np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)[: int(new.sum())]
            own = [np.concatenate([*c, x]) for c, x in zip(known, (row[order][new], begin[new], end[last]), strict=True)]
            # stretches stand under a string of their own, so that none of them gathers in one task
            apart = _pair(own[0].astype(np.uint64), own[1].astype(np.uint64)).view(np.int64)
            arrays = [np.concatenate([string[filed].view(np.int64), apart]), np.concatenate([run[filed].view(np.int64), own[1]]), np.concatenate([first[filed] << 7 | size[filed], own[1]])]
            upto = pa.array(np.concatenate([np.zeros(len(filed), np.int64), own[2]]), mask=np.repeat([True, False], [len(filed), len(own[0])]))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(np.concatenate([row[filed], own[0]]))), *map(pa.array, arrays), upto], schema=_FILED)


def _bytes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, string, start, rank) of each window of a batch of runs with their bytes."""
    first, parts = (batch.column("run").to_numpy() >> 7), []
    for k, payload in enumerate(batch.column("bytes")):
        ranks = _window_ranks(np.frombuffer(payload.as_buffer(), np.uint8))
        parts.append((np.full(len(ranks), k), first[k] + np.arange(len(ranks)), ranks))
    row, start, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, batch.column("string").to_numpy()[row], start, rank.view(np.int64)


def _stretches(doc: pa.Array, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows (row, start), in order, as stretches (doc_id, a, b) of successive ones."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    return pa.RecordBatch.from_arrays([doc.take(pa.array(row[first])), pa.array(start[first], pa.int64()), pa.array(start[first] + size, pa.int64())], ["doc_id", "a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by string -> stretches of repeated windows; a string's runs are looked at together."""

    def repeated(part: pa.Table) -> pa.RecordBatch:
        batch = part.combine_chunks().to_batches()[0]
        row, string, start, rank = _bytes_of(batch)
        # places are compared by (doc_id, start); a null id is smaller than any other
        doc = batch.column("doc_id")
        known = np.asarray(doc.is_valid())[row]
        ids = np.asarray(doc.fill_null(0))[row]
        order = np.lexsort((start, ids, known, rank, string))
        r, s, d, k, t = rank[order], string[order], ids[order], known[order], start[order]
        head = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
        least = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (d != d[least]) | (k != k[least]) | (t != t[least])
        gone = np.zeros(len(row), bool)
        gone[order[later]] = True
        return _stretches(doc, row[gone], start[gone])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        strings = batch.column("string").to_numpy()
        cut = int(np.argmax(strings == strings[-1]))  # where the last string begins
        if held and (cut or held[-1].column("string")[-1].as_py() != strings[0]):
            part = pa.Table.from_batches([*held, batch.slice(0, cut)])
            for at in _even(part):
                yield repeated(at)
            held = []
        elif cut:
            for at in _even(pa.Table.from_batches([batch.slice(0, cut)])):
                yield repeated(at)
        held.append(batch.slice(cut))
    if held:
        for at in _even(pa.Table.from_batches(held)):
            yield repeated(at)


def _even(part: pa.Table, rows: int = 4096) -> Iterator[pa.Table]:
    """Cuts a table that is sorted by string into parts of some rows, never within a string."""
    strings = part.column("string").to_numpy()
    ends = np.append(np.flatnonzero(strings[1:] != strings[:-1]) + 1, len(strings)) if len(strings) else np.zeros(0, np.int64)
    at = 0
    while at < len(strings):
        end = int(ends[min(np.searchsorted(ends, at + rows), len(ends) - 1)])
        yield part.slice(at, end - at)
        at = end


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            row, string, start, rank = _bytes_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(string), pa.array(rank), pa.array(start)], ["doc_id", "string", "rank", "start"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            rows = []
            for text, gone in zip(batch.column("text").cast(pa.binary()), batch.column("gone"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, removed, spans, end, kept, at = len(data), [], [], -1, hashlib.sha256(), 0
                if gone.is_valid:
                    pairs = gone.values.flatten()
                    a, b = pairs[0].to_numpy(zero_copy_only=False), pairs[1].to_numpy(zero_copy_only=False) + LENGTH - 1
                    order = np.argsort(a, kind="stable")
                    for x, y in zip(a[order].tolist(), np.minimum(b[order], n).tolist(), strict=True):
                        if x > end:
                            spans.append([x, y])
                            end = y
                        elif y > end:
                            spans[-1][1] = end = y
                for x, y in spans:
                    kept.update(data[at:x])
                    removed.append(y - x)
                    at = y
                kept.update(data[at:])
                rows.append((n, sum(removed), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )


def remove_repeats(docs: DataFrame, many_runs: int = MANY_RUNS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), a row for each row.

    spans: begin and end of each removed run of bytes, in turn. Null texts count as empty; texts under LENGTH bytes
    stay whole; a null doc_id is smaller than any other. Rows that repeat a doc_id stand at the same place: neither
    is earlier than the other, and all of them lose what any of them loses at that place.
    """
    docs = docs.select("doc_id", "text")
    filed = docs.mapInArrow(_filed, "doc_id long, string long, whole long, run long, upto long").repartition("string")
    kind = F.col("upto").isNotNull()
    same = Window.partitionBy("string", "kind", "whole").orderBy("doc_id", "run")
    every = Window.partitionBy("string", "kind")
    # rows that repeat a doc_id file the same places: rank 1 is all of them, nth 1 stands for them
    ranked = filed.withColumn("kind", kind).withColumn("rank", F.rank().over(same)).withColumn("nth", F.row_number().over(same))
    ranked = ranked.withColumn("runs", F.sum((F.col("nth") == 1).cast("long")).over(every))
    kept = ranked.where("kind or rank > 1 or (nth = 1 and runs > 1)")
    found = stored(kept.select("doc_id", "run", "upto", F.when(~F.col("kind") & (F.col("rank") == 1), F.col("string")).alias("string"), (F.col("runs") > many_runs).alias("many")))
    repeated = found.where("string is null").select("doc_id", F.expr("if(upto is null, run >> 7, run)").alias("a"), F.expr("coalesce(upto, (run >> 7) + (run & 127))").alias("b"))
    some = found.where("string is not null").select(F.col("doc_id").alias("of"), "run", "string", "many")
    texts = docs.join(some, F.col("doc_id").eqNullSafe(F.col("of")))
    piece = F.substring(F.col("text").cast("binary"), F.expr("int(run >> 7) + 1"), F.expr("int(run & 127) + 99"))
    runs = texts.select("doc_id", "string", "run", "many", piece.alias("bytes")).where(F.octet_length("bytes") >= LENGTH)
    few = runs.where("not many").select("doc_id", "string", "run", "bytes").repartition("string").sortWithinPartitions("string")
    stretches = few.mapInArrow(_compared, "doc_id long, a long, b long")
    single = runs.where("many").select("doc_id", "string", "run", "bytes").mapInArrow(_single, "doc_id long, string long, rank long, start long")
    later = single.withColumn("nth", F.rank().over(Window.partitionBy("string", "rank").orderBy("doc_id", "start"))).where("nth > 1").select("doc_id", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    return _without(docs, repeated.unionByName(stretches).unionByName(later))


def _without(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """The documents without the windows of stretches(doc_id, a, b)."""
    gone = stretches.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "gone").mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def doubled(docs: DataFrame) -> DataFrame:
    """The same by prefix doubling over every byte, for texts of distinct doc_ids without nulls.

    The rank of a string is the least place, (doc_id, start), that has it. Spark sorts the pairs of ranks at offsets 1, 2,
    4 ... 32 and at last 36, and each pair gets its own least place as its rank; a place whose pair occurs once drops
    out. No hashes: this is exact, and the measure of ``remove_repeats``. Every round moves tens of bytes for each byte.
    """
    docs = docs.select("doc_id", "text")
    data = F.col("text").cast("binary")
    places = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", F.explode(F.sequence(F.lit(1), F.octet_length("text"))).alias("at"), data.alias("data"))
    rows = places.select("doc_id", (F.col("at") - 1).cast("long").alias("at"), F.substring("data", F.col("at"), F.lit(1)).alias("x"), F.lit(None).cast("binary").alias("y"))

    def reranked(rows: DataFrame) -> DataFrame:
        classes = rows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "at")).alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n")
        return cut(rows.join(classes, rows["x"].eqNullSafe(classes["x"]) & rows["y"].eqNullSafe(classes["y"])).select("doc_id", "at", "rank"))

    ranks = reranked(rows)
    for offset in (1, 2, 4, 8, 16, 32, LENGTH - 64):
        right = ranks.select("doc_id", (F.col("at") - offset).alias("at"), F.col("rank").alias("y"))
        ranks = reranked(ranks.withColumnRenamed("rank", "x").join(right, ["doc_id", "at"]))
    later = ranks.where("rank <> struct(doc_id, at)").select("doc_id", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    return _without(docs, later)
