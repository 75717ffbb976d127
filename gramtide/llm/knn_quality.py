"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: its words, their shapes, and its own shares of repetition, capitals and symbols in
steps. TF-IDF vectors of a bounded sample of labelled documents give, by truncated SVD, a latent space; the labelled
vectors are broadcast. Every document is compared with all of them by exact cosine, in blocks of documents, and its
nearest neighbours vote by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut, text_slices
from .quality_rules import repeat_words

#: Labelled documents that the classifier is fitted on, at most: those with the least hash of their id, so many of
#: each label. With DIMENSIONS this bounds what is broadcast (3,000 * 64 * 4 bytes, and TERMS * 64 * 4 bytes).
MAX_PER_LABEL = 1500
TERMS = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
#: Similarities are raised to this power as weights.
SHARPNESS = 8
#: Documents of a block of cosine products.
BLOCK = 512
KEEP = 0.3
#: Words that a task remembers, and the longest of them; longer ones are hashed each time.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 200
#: Weight of the terms that describe the whole text against that of its words together.
WHOLE = 1.5

_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"\d+"), "9"))


def _hash(term: str) -> int:
    return zlib.crc32(term.encode()) % TERMS


def _shape(word: str) -> str:
    for run, letter in _RUNS:
        word = run.sub(letter, word)
    return re.sub(r"(.)\1+", r"\1\1", word)


def _step(name: str, share: float) -> list[int]:
    """A share as terms of its step and the steps next to it, so that near shares are similar."""
    at = round(20 * min(1.0, max(0.0, share)))
    return [_hash(f"\0{name}:{k}") for k in (at - 1, at, at, at + 1)]


#: Counted terms: (ids, counts) of the words and shapes, (ids, counts) of the whole text. At most 2 * TERMS numbers each.
Terms = tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _terms(text: str, known: dict[str, tuple[int, int]]) -> Terms:
    words = text.split()
    pairs = []
    for w in words:
        if (p := known.get(w)) is None:
            p = (_hash(w.lower()), _hash("\1" + _shape(w)))
            if len(w) <= REMEMBERED_LENGTH:
                known[w] = p
        pairs.append(p)
    letters = len(text) or 1
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÉÈÖÜÄÑÓ"))
    symbols, marks = sum(map(text.count, "#*$%&|<>")), sum(map(text.count, "!?"))
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    whole = [
        *_step("repeat", repeat_words([w.encode("utf-8", "surrogatepass") for w in words]) / n),
        *_step("distinct", len(set(words)) / n),
        *_step("capitals", capitals / letters),
        *_step("symbols", symbols / n),
        *_step("marks", marks / n),
        *_step("lines", len(set(lines)) / max(1, len(lines))),
        *_step("size", np.log2(1 + len(words)) / 16),
        *_step("longest", max(map(len, words), default=0) / 100),
    ]
    return np.unique(np.array(pairs, np.int64).reshape(-1), return_counts=True), np.unique(np.array(whole, np.int64), return_counts=True)


class Space:
    """idf, projection and the labelled vectors; everything that the executors need."""

    def __init__(self, idf: np.ndarray, project: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.project, self.vectors, self.labels = idf, project, vectors, labels


def _weights(terms: Terms, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, values = [], []
    for (i, c), weight in zip(terms, (1.0, WHOLE), strict=True):
        v = (1 + np.log(c)) * idf[i]
        ids.append(i)
        values.append(weight * v / (np.linalg.norm(v) or 1.0))
    return np.concatenate(ids), np.concatenate(values).astype(np.float32)


def fit(terms: list[Terms], labels: list[int]) -> Space:
    """Latent space of a bounded labelled sample, by randomised subspace iteration."""
    seen = np.zeros(TERMS)
    for (a, _), (b, _) in terms:
        seen[np.union1d(a, b)] += 1
    idf = np.log((1 + len(terms)) / (1 + seen)) + 1
    matrix = np.zeros((len(terms), TERMS), np.float32)
    for row, t in zip(matrix, terms, strict=True):
        i, v = _weights(t, idf)
        np.add.at(row, i, v)
    k = min(DIMENSIONS, *matrix.shape) if terms else 1
    base = np.random.default_rng(0).standard_normal((TERMS, k)).astype(np.float32)
    for _ in range(4):
        base = np.linalg.qr(matrix.T @ (matrix @ base))[0] if terms else base
    vectors = matrix @ base
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Space(idf, np.ascontiguousarray(base), vectors, np.array(labels, np.float32))


def score_block(space: Space, block: np.ndarray) -> np.ndarray:
    """Scores of a block of latent vectors by their exact nearest neighbours."""
    if not len(space.labels):
        return np.full(len(block), 0.5)
    block = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    cosine = block @ space.vectors.T
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
    return np.clip((weight * space.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def scores(docs: DataFrame, space: Space) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score); a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, known = shared.value, {}
        for whole in batches:
            for part in text_slices(whole):
                for at in range(0, part.num_rows, BLOCK):
                    batch = part.slice(at, BLOCK)
                    if len(known) > REMEMBERED:
                        known = {}
                    block = np.empty((batch.num_rows, space.project.shape[1]), np.float32)
                    for row, text in zip(block, batch.column("text").to_pylist(), strict=True):
                        ids, values = _weights(_terms(text or "", known), space.idf)
                        row[:] = values @ space.project[ids]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_block(space, block).astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def _counted(learn: DataFrame) -> DataFrame:
    """(doc_id, quality, a, an, b, bn): the counted terms of the sample, so that no text reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                known: dict[str, tuple[int, int]] = {}
                terms = [_terms(t or "", known) for t in batch.column("text").to_pylist()]
                lists = [pa.array([t[part][k].tolist() for t in terms], pa.list_(pa.int64())) for part in (0, 1) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), *lists], ["doc_id", "quality", "a", "an", "b", "bn"])

    return learn.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, a array<long>, an array<long>, b array<long>, bn array<long>")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_label: int = MAX_PER_LABEL) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality) -> (doc_id, held_out, score, predicted), one row for each row.

    Learns only outside the held-out fold (crc32 of the id as text, modulo ``folds``) and only from labels that are
    not null; of several labels of a document the least counts; of rows that repeat a doc_id one teaches (that with
    the least terms). A null id is never held out. Without any label all scores are 0.5. Null texts score like empty
    ones, texts of any length are whole; among neighbours of equal similarity at the last place any may vote. Other
    columns, whatever their names, are ignored; no rows give no rows.
    """
    out = F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.least(F.col("quality"), F.lit(1))).alias("quality")).where(~out)
    # labels without a document teach nothing
    known = cut(known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = cut(known.where("quality = 1").orderBy(*order).limit(per_label).unionByName(known.where("quality = 0").orderBy(*order).limit(per_label)))
    counted = _counted(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # of rows that repeat an id one teaches, so at most 2 * per_label rows reach the driver
    learn = counted.groupBy("doc_id").agg(F.min(F.struct("quality", "a", "an", "b", "bn")).alias("r")).select("doc_id", "r.*")
    rows = sorted((r["doc_id"], int(r["quality"]), *map(tuple, (r["a"], r["an"], r["b"], r["bn"]))) for r in learn.toLocalIterator())
    as_terms = lambda r: tuple((np.array(i, np.int64), np.array(c, np.int64)) for i, c in (r[2:4], r[4:6]))
    space = fit([as_terms(r) for r in rows], [r[1] for r in rows])
    return scores(docs, space).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
