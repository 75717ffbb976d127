"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints that differ in at most 4 bits are cut into three segments: one of the segments then differs in
at most one bit. Every segment is indexed once for each of its bits with that bit wiped out, so two segments that
differ in at most one bit share a variant. Fingerprints that share a variant meet in a bucket, where links are
verified over all 64 bits and only a spanning forest of them is passed on: a bucket gives fewer rows than it has
members, never all its pairs, and no link between different fingerprints is lost for the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_join, text_slices
from .graph import components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (first bit, width) of the segments; 4 differing bits over 3 segments leave one with at most 1.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket beyond which it is dealt out anew by variants of the bits that its key leaves open.
BUCKET = 16_384
#: Open bits from which on a bucket isn't dealt out again.
FEW_OPEN = 12


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles (ASCII lower case, ASCII white space); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            values = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp); one row for each row. A null text has no words: fingerprint 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _variants(fp: Column, segments: tuple[tuple[int, int], ...]) -> Column:
    """One key for each bit of the segments: the place of that bit and the segment's other bits."""
    keys, n = [], 0
    for first, width in segments:
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            keys.append(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit(n << 32).cast("long")))
            n += 1
    return F.array(*keys)


def forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Star edges (root, member) of the components of unequal fingerprints under at most MAX_BITS differing bits."""
    roots, members, rest = [], [], fps
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and rest.size:
            near = np.bitwise_count(rest ^ queue.pop()) <= MAX_BITS
            if near.any():
                hit, rest = rest[near], rest[~near]
                roots.append(np.full(len(hit), root))
                members.append(hit)
                queue.extend(hit)
    return roots, members


def _linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all buckets of arrays that are sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(keys)))
    roots, members = [], []
    two = first[sizes == 2]
    near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= MAX_BITS]
    roots.append(fps[near])
    members.append(fps[near + 1])
    for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = fps[a : a + n]
        if n <= 16:  # most small buckets hold no link
            x = own[:, None] ^ own[None, :]
            if np.count_nonzero(np.bitwise_count(x) <= MAX_BITS) == n:
                continue
        r, m = forest(own)
        roots += r
        members += m
    pairs = np.stack([np.concatenate(roots), np.concatenate(members)], axis=1)
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, open, fp) sorted by bucket -> forest edges (a, b) of each bucket."""
    kept_keys, kept_fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _linked(keys, fps)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([kept_keys, np.stack([batch.column(c).to_numpy() for c in ("key", "open")], axis=1)])
        fps = np.concatenate([kept_fps, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        # the last bucket may go on in the next batch
        last = len(keys) - int(np.argmin(np.append(np.all(keys[::-1] == keys[-1], axis=1), False)))
        yield edges(keys[:last], fps[:last])
        kept_keys, kept_fps = keys[last:], fps[last:]
    yield edges(kept_keys, kept_fps)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, open, fp) -> one row for each wildcard variant of the bits that their bucket leaves open.

    The open bits are cut in three again: two fingerprints of a bucket differ in at most MAX_BITS of them, so in one
    part by at most one bit. The new key is a hash of the old one and the variant; what it leaves open are the other parts.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 14):
            key, open_, fp = (whole.slice(at, 1 << 14).column(c).to_numpy().view(np.uint64) for c in ("key", "open", "fp"))
            for mask in np.unique(open_).tolist():
                rows = open_ == mask
                bits = [b for b in range(64) if mask >> b & 1]
                for n, part in enumerate((bits[0::3], bits[1::3], bits[2::3])):
                    held = sum(1 << b for b in part)
                    for bit in part:
                        new = key[rows] * np.uint64(0x9E3779B97F4A7C15) ^ (fp[rows] & np.uint64(held & ~(1 << bit))) * np.uint64(0xC2B2AE3D27D4EB4F)
                        new = (new ^ new >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n << 8 | bit)
                        left = np.full(len(new), mask & ~held, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (new, left, fp[rows])], ["key", "open", "fp"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fps(fp), without repeats -> (a, b): a spanning set of the links between fingerprints.

    Buckets of more than ``bucket`` members are found by counting, so that none of them comes into one task, and are
    dealt out by the bits that they leave open, again and again. A bucket with FEW_OPEN open bits or less isn't: it
    can't have more than 2 ** FEW_OPEN members for each bit that was wiped on the way.
    """
    keys = []
    for n, (first, width) in enumerate(SEGMENTS):
        held = ((1 << width) - 1) << first
        open_ = np.array([(1 << 64) - 1 & ~held], np.uint64).view(np.int64)[0]
        keys += [(n, int(open_))]
    place = F.shiftrightunsigned("key", 32)
    ends = np.cumsum([w for _, w in SEGMENTS]).tolist()
    left = F.lit(keys[-1][1])
    for (_, open_), end in zip(keys[:-1][::-1], ends[:-1][::-1], strict=True):
        left = F.when(place < end, F.lit(open_)).otherwise(left)
    rows = fps.select("fp", F.explode(_variants(F.col("fp"), SEGMENTS)).alias("key")).select("key", left.alias("open"), "fp")
    found = None
    while True:
        sizes = rows.groupBy("key", "open").agg(F.count("*").alias("n")).where((F.col("n") > bucket) & (F.bit_count("open") > FEW_OPEN))
        large = cut(sizes.select("key", "open"))
        more = large.limit(1).count() > 0
        small = sized_join(rows, large, ["key", "open"], "left_anti") if more else rows
        edges = cut(small.repartition("key", "open").sortWithinPartitions("key", "open", "fp").mapInArrow(_met, "a long, b long").distinct())
        found = edges if found is None else found.unionByName(edges)
        if not more:
            return found.distinct()
        rows = cut(sized_join(rows, large, ["key", "open"], "left_semi").mapInArrow(_finer, "key long, open long, fp long"))


#: What the number of a node without a doc_id begins with: over all ids.
_NO_ID = 1 << 62


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest doc_id that links lead to. Texts without words, null and empty ones included, have
    fingerprint 0 and link like any other. Rows that repeat an id get the same result each; a null id counts only
    where a component has no other (ids are under 2 ** 62). Texts of any length are whole. Other columns are ignored;
    no rows give no rows.
    """
    prints = cut(fingerprints(docs))
    # the smallest doc_id of a fingerprint is its node, so a component's root is its component_id. Fingerprints without
    # an id share a node only if they differ in nothing but two bits, which links them anyway.
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.col("fp").bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID))).alias("id")))
    side = lambda fp, id_: distinct.select(F.col("fp").alias(fp), F.col("id").alias(id_))
    edges = sized_join(sized_join(links(distinct.select("fp")), side("a", "x"), "a", "inner"), side("b", "y"), "b", "inner")
    roots = cut(components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct())
    of = cut(sized_join(distinct, roots.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("root", "id").alias("root")))
    named = F.when(F.col("root") < _NO_ID, F.col("root")).alias("component_id")
    return sized_join(prints, of, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), named)
