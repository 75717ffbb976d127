"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a bound.

Candidates come from SimHash: fingerprints of the sets meet by the deletion variants of ``simhash.links``, and those
that differ in at most 4 bits are tied. At 0.8 pairs differ in about 10 of 64 bits, and segments for that get too short
to part the corpus, so MinHash bands tie what the bits leave apart: a pair of similarity 0.8 shares one of 20 bands of 6
minima with probability 0.998, a more similar one more likely. Members of a bucket are tied to its least member, so a
bucket gives fewer rows than members, and what is tied is a group in which every similarity is taken exactly.

A group of up to GROUP members (and GROUP_SHINGLES) is looked at in one task. A larger one never is: its members are
compared, in blocks, with PIVOTS of them; most then hang together. Those that don't are compared with all members, again
block by block. Every pair is so compared, or known to hang together already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import cut, sized_join, stored, text_slices
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
SEED = 42
#: Members of a group, and shingles of all of them, that one task looks at.
GROUP, GROUP_SHINGLES = 2048, 4 << 20
#: Of a larger group: members that all are compared with first, members and shingles of a block, and of those compared anew.
PIVOTS, BLOCK, BLOCK_SHINGLES, REST_BLOCK = 8, 1024, 2 << 20, 256
#: Parts into which a component's nodes are dealt when they learn its least id.
SALTS = 16
_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles (ASCII lower case, ASCII white space); a shorter text is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A signed key for each band; none for a text without words."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * _MULTIPLY + _ADD).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _node(found: np.ndarray) -> int:
    """Names a set: texts with equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def print_of(found: np.ndarray) -> int:
    """SimHash of a set, signed: a bit is 1 if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 14):
        ones += np.unpackbits(found[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.binary())]


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found = [shingles(t, shingle) for t in _bytes(batch)]
                nodes, keys = pa.array(map(_node, found), pa.int64()), pa.array(map(bands, found), pa.list_(pa.int64()))
                prints, sizes = pa.array(map(print_of, found), pa.int64()), pa.array(map(len, found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held"), nodes, prints, keys, sizes], ["doc_id", "held", "node", "fp", "bands", "n"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                found = [shingles(t, shingle).tobytes() for t in _bytes(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(found, pa.binary())], ["root", "node", "members"])

    return run


def verified(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A component number for each set: the least place that links of at least this similarity lead to."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(flat.max() + 1, np.int64)
    starts = np.cumsum(sizes) - sizes
    out, rest = np.arange(len(sets)), np.arange(len(sets))
    values = flat  # the hashes of the sets in rest
    while len(rest) > 1:
        root, queue = rest[0], [rest[0]]
        values, rest = values[sizes[root] :], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = flat[starts[at] : starts[at] + sizes[at]]
            mark[own] = 1
            both = np.add.reduceat(mark[values], np.cumsum(sizes[rest]) - sizes[rest])
            mark[own] = 0
            near = both >= similarity * (sizes[at] + sizes[rest] - both) - 1e-9
            if near.any():
                hit = rest[near]
                out[hit] = root
                queue.extend(hit)
                values, rest = values[np.repeat(~near, sizes[rest])], rest[~near]
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): places of the pairs of at least this similarity."""
    flat, of = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = np.array([len(x) for x in right])
    own, values = np.split(of, [sum(map(len, left))])
    mark, starts = np.zeros(len(flat), np.int64), np.cumsum(sizes) - sizes
    i, j, at = [], [], 0
    for k, x in enumerate(left):
        mark[own[at : at + len(x)]] = 1
        both = np.add.reduceat(mark[values], starts)
        mark[own[at : at + len(x)]] = 0
        at += len(x)
        hit = np.flatnonzero(both >= similarity * (len(x) + sizes - both) - 1e-9)
        i.append(np.full(len(hit), k))
        j.append(hit)
    return np.concatenate(i), np.concatenate(j)


def _compared(left: DataFrame, right: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """(a, b): left(key..., node, members) against right by key: links between different nodes."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        i, j = similar([np.frombuffer(m, np.uint64) for m in x["members"]], [np.frombuffer(m, np.uint64) for m in y["members_"]], similarity)
        a, b = x["node"].to_numpy()[i], y["node_"].to_numpy()[j]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    # both sides come from one table: other names keep them apart
    other = right.select(*[F.col(c).alias(f"{c}_") for c in (*key, "node", "members")])
    return left.select(*key, "node", "members").groupBy(*key).cogroup(other.groupBy(*[f"{c}_" for c in key])).applyInPandas(run, "a long, b long")


def _large(sets: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """sets(root, node, members) of large groups, sizes(root, members, shingles) -> (a, b), links that span each group's
    components."""
    blocks = F.greatest(F.ceil(F.col("members_n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = sized_join(sets, sizes.select("root", blocks.alias("blocks")), "root", "inner")
    dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    copies = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    # a few members by hash stand for the group: the least of each block, then the least of all
    turn = F.xxhash64("node", F.lit(SEED))
    first = dealt.groupBy("root", "block").agg(F.min_by("node", turn).alias("node"))
    chosen = first.withColumn("turn", F.row_number().over(Window.partitionBy("root").orderBy(turn))).where(F.col("turn") <= PIVOTS).select("root", "node")
    pivots = sized_join(dealt, cut(chosen), ["root", "node"], "left_semi").select("root", "node", "members", copies)
    links = cut(_compared(dealt, pivots, ["root", "block"], similarity))
    hang = components(links)
    # each group's largest part hangs together; what isn't of it is compared with all
    part = cut(sized_join(dealt.select("root", "node"), cut(hang.select("node", F.col("root").alias("part"))), "node", "left").select("root", "node", F.coalesce("part", "node").alias("part")))
    most = part.groupBy("root", "part").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    rest = cut(sized_join(part, cut(most), "root", "inner").where("part <> main").select("root", "node"))
    if not rest.limit(1).count():
        return links
    counts = cut(rest.groupBy("root").agg(F.ceil(F.count("*") / REST_BLOCK).cast("int").alias("parts")))
    asked = sized_join(sized_join(dealt, rest, ["root", "node"], "left_semi"), counts, "root", "inner")
    asked = asked.select("root", "node", "members", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), copies)
    met = sized_join(dealt, counts, "root", "inner").select("root", "node", "members", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return links.unionByName(_compared(asked, met, ["root", "block", "part"], similarity))


def tied(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp, bands, n) -> (a, b): what SimHash links, and what shares a band; sets without shingles aren't tied."""
    prints = cut(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    side = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("first").alias(name))
    edges = simhash.links(prints.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = sized_join(sized_join(edges, side("x", "a"), "x", "inner"), side("y", "b"), "y", "inner").select("a", "b")
    same = sized_join(nodes.where("n > 0").select("node", "fp"), cut(prints.where("n > 1").select("fp", "first")), "fp", "inner")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = same.select("node", "first").unionByName(keyed.join(shared, "key").select("node", "first"))
    return near.unionByName(met.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))).distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, component_id), one row for each row of docs.

    component_id is the smallest doc_id that links of at least this similarity lead to; texts without words, null and
    empty ones included, are alike. Rows that repeat an id get the same result each where their texts are equal. A null
    id counts only where a component has no other. Texts of any length are whole; other columns, whatever their names,
    are ignored; no rows give no rows. BANDS and ROWS suit bounds of 0.8 and more.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("held"))
    rows = cut(texts.mapInArrow(_signed(shingle), "doc_id long, held long, node long, fp long, bands array<long>, n long"))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("held").alias("held"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n")))
    candidates = cut(components(cut(tied(nodes))).join(nodes.select("node", "held", "n"), "node").select("node", "root", "held", "n"))
    sizes = candidates.groupBy("root").agg(F.count("*").alias("members_n"), F.sum("n").alias("shingles"))
    large = cut(sizes.where((F.col("members_n") > GROUP) | (F.col("shingles") > GROUP_SHINGLES)))
    met = sized_join(texts.select("text", "held"), candidates.drop("n"), "held", "inner").dropDuplicates(["held"])
    sets = met.select("root", "node", "text").mapInArrow(_sets(shingle), "root long, node long, members binary")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        at = verified([np.frombuffer(b, np.uint64) for b in pdf["members"]], similarity)
        return pd.DataFrame({"node": pdf["node"], "root": pdf["node"].to_numpy()[at]})

    if large.limit(1).count():
        sets = stored(sets)
        of_large = components(_large(sized_join(sets, large.select("root"), "root", "left_semi"), large, similarity))
        roots = sized_join(sets, large.select("root"), "root", "left_anti").groupBy("root").applyInPandas(check, "node long, root long").unionByName(of_large.distinct())
    else:
        roots = sets.groupBy("root").applyInPandas(check, "node long, root long")
    rooted = cut(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    # most nodes are a component of their own; the others get the least id of theirs, joined without gathering one
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    of = rooted.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(named.select("root", "component_id", salts), ["root", "salt"], "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return sized_join(rows.select("doc_id", "node"), cut(of), "node", "left").select("doc_id", "component_id")
