"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``CHUNK`` bytes. Each chunk has a hash ``sum(byte * base ** (bytes that follow in the
chunk)) mod p`` under two primes; the hashes of neighbours combine as ``h(xy) = h(x) * base ** len(y) + h(y)``. Texts
are cut into strips of many chunks, each a row of its own, so the strips of a huge text are hashed by different calls
in any order; each is shifted by the length of what follows it, and the sum of the strips is the text's fingerprint.
Texts with one fingerprint are then compared strip by strip, each strip chunk by chunk, and only texts that are equal
in every chunk share a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_join, small_enough, stored, text_slices

#: Two primes just under 2 ** 31: a byte times a residue, summed over a chunk, stays under 2 ** 63.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
CHUNK = 4096
#: Bytes of a strip: what one row of the hashing and of the comparison holds. A multiple of CHUNK.
STRIP = 1 << 18
#: Members of groups up to which their ids are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


_POWERS = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hashes(data: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the successive chunks of a byte array; the last one may be short."""
    prime, powers = np.uint64(PRIMES[which]), _POWERS[which]
    whole = len(data) // CHUNK
    out = (data[: whole * CHUNK].reshape(whole, CHUNK).astype(np.uint64) @ powers[::-1]) % prime
    if rest := len(data) - whole * CHUNK:
        out = np.append(out, (data[whole * CHUNK :].astype(np.uint64) @ powers[:rest][::-1]) % prime)
    return out


def combine(left: tuple[int, int], right: tuple[int, int], which: int) -> tuple[int, int]:
    """(hash, length) of two neighbours -> (hash, length) of both; associative."""
    prime = PRIMES[which]
    return (left[0] * pow(BASES[which], right[1], prime) + right[0]) % prime, left[1] + right[1]


def shifted(data: np.ndarray, follow: int, which: int) -> int:
    """The hash of a strip, times base ** follow: its part of the hash of a text in which ``follow`` bytes come after."""
    at = (0, 0)
    for k, h in enumerate(chunk_hashes(data, which)):
        at = combine(at, (int(h), min(CHUNK, len(data) - k * CHUNK)), which)
    return at[0] * pow(BASES[which], follow, PRIMES[which]) % PRIMES[which]


def fingerprint(data: bytes, strip: int = STRIP) -> int:
    """62 bits: the residues under both primes. The length is kept apart."""
    view, out = np.frombuffer(data, np.uint8), 0
    for which in (0, 1):
        parts = [shifted(view[i : i + strip], max(0, len(view) - i - strip), which) for i in range(0, len(view), strip)]
        out = out << 31 | sum(parts) % PRIMES[which]
    return out


def _strips(text: Column, strip: int) -> Column:
    """(place, bytes) of the strips of a binary column; bytes are taken by place, so a text is walked once."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(text) - 1) / strip)).cast("int"))
    return F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(text, i * strip + 1, F.lit(strip)).alias("text"))))


def _parts(strip: int):
    """Each strip's shifted hashes under both primes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found: tuple[list, list] = [], []
                for text, place, n in zip(batch.column("text"), batch.column("place").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    view = np.frombuffer(text.as_buffer(), np.uint8)
                    for which in (0, 1):
                        found[which].append(shifted(view, n - place * strip - len(view), which))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n", "sha")), *(pa.array(f, pa.int64()) for f in found)], ["row", "doc_id", "n", "sha", "x", "y"])

    return run


def fingerprints(docs: DataFrame, strip: int = STRIP) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, n, sha), stored; text is a string without nulls."""
    data = F.col("text").cast("binary")
    # a number for each row: it follows from the place in the stored table, so a repeated task gives it again
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", data.alias("data"), F.octet_length("text").cast("long").alias("n"), F.sha2(data, 256).alias("sha"))
    cut_up = rows.select("row", "doc_id", "n", "sha", _strips(F.col("data"), strip).alias("s")).select("row", "doc_id", "n", "sha", "s.place", "s.text")
    parts = stored(cut_up.mapInArrow(_parts(strip), "row long, doc_id long, n long, sha string, x long, y long"))
    fp = lambda x, y: F.shiftleft(x, 31).bitwiseOR(y).alias("fp")
    one = parts.where(F.col("n") <= strip).select("doc_id", fp(F.col("x"), F.col("y")), "n", "sha")
    sums = parts.where(F.col("n") > strip).groupBy("row", "doc_id", "n", "sha").agg(*[(F.sum(c) % p).cast("long").alias(c) for c, p in zip("xy", PRIMES, strict=True)])
    return one.unionByName(sums.select("doc_id", fp(F.col("x"), F.col("y")), "n", "sha"))


def _met(held_bytes: int):
    """Strips (fp, n, place, text) -> the first that a task meets of each place of a group, and where another differs.

    The others are compared with it byte by byte and go no further. At most about ``held_bytes`` are held: then all
    are forgotten, and the next of each place stands for it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int, int], pa.Buffer] = {}
        size = 0
        for batch in batches:
            rows, differ = [], []
            for k, (key, text) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("fp", "n", "place")), strict=True), batch.column("text"), strict=True)):
                data = text.as_buffer()
                if (known := first.get(key)) is None:
                    if size > held_bytes:
                        first, size = {}, 0
                    first[key] = pa.py_buffer(data.to_pybytes())
                    size += data.size + 200
                elif known.equals(data):
                    continue
                rows.append(k)
                differ.append(known is not None)
            out = batch.select(["fp", "n", "place", "text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(differ, pa.bool_())], ["fp", "n", "place", "text", "differ"])

    return run


def _differing(docs: DataFrame, members: DataFrame, strip: int, held_bytes: int = 32 << 20) -> DataFrame:
    """(fp, n): the fingerprints that different texts share, by comparing the texts strip by strip.

    A task compares what it reads itself and passes on one strip for each place, so of a group of any size a few rows
    for each task are shuffled; their least and greatest are the same if all are.
    """
    ids = members.distinct().withColumnRenamed("doc_id", "member")
    texts = docs.join(F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids, F.col("doc_id").eqNullSafe(F.col("member"))).where(F.octet_length("text") == F.col("n"))
    strips = texts.select("fp", "n", _strips(F.col("text").cast("binary"), strip).alias("s")).select("fp", "n", "s.place", "s.text")
    met = strips.mapInArrow(_met(held_bytes), "fp long, n long, place int, text binary, differ boolean")
    compared = met.groupBy("fp", "n", "place").agg((F.max("differ") | (F.min("text") != F.max("text"))).alias("differ"))
    return compared.where("differ").select("fp", "n").distinct()


def exact_groups(docs: DataFrame, strip: int = STRIP) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Null texts count as empty; empty texts form a group like any other. The largest doc_id of a group stays (a null
    id is smaller than any other). Rows that repeat a doc_id with the same text are all marked kept if their id is
    the one that stays. Texts of any length are whole; a worker holds a strip at a time. Other columns, whatever
    their names, are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = fingerprints(docs, strip)
    groups = prints.groupBy("fp", "n").agg(F.count("*").alias("size"))
    shared = cut(groups.where("size > 1").select("fp", "n"))
    members = cut(sized_join(prints, shared, ["fp", "n"], "left_semi").where("n > 0").select("doc_id", "fp", "n"))
    differ = cut(_differing(docs, members, strip))
    # where one fingerprint has different texts, its rows are told apart by their digest
    told = prints.withColumn("own", F.lit(""))
    if differ.limit(1).count():
        apart = sized_join(prints, differ.withColumn("apart", F.lit(True)), ["fp", "n"], "left")
        told = apart.withColumn("own", F.when(F.col("apart"), F.col("sha")).otherwise("")).drop("apart")
    groups = cut(told.groupBy("fp", "n", "own").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"))
    return sized_join(told, groups, ["fp", "n", "own"], "left", BROADCAST_ROWS).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
