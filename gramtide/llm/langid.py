"""Language identification, word first.

A word that the model knows has a log frequency in every language. A word that it doesn't know is scored by its
character n-grams: by those of the greatest length of which the model knows at least one, then shorter ones. The
sum over a text's words decides. Words are the runs of letters of the lower-cased text, in learning and predicting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, cut, sized_join, small_enough, text_slices

#: Every language is learnt from at most so many of its documents, those with the least hash of their id.
MAX_TRAIN = 20_000
#: Words, and n-grams of each length, by which each language adds to the model: about so many, its most frequent.
MAX_WORDS, MAX_GRAMS = 30_000, 10_000
#: Frequencies (words x languages) that the model's words, or its n-grams of one length, hold at most.
MAX_CELLS = 75_000_000
LONGEST = 4
#: Words that a worker remembers.
REMEMBERED = 100_000
#: Parts of the hashes of ids; a language's documents are chosen by parts, and row by row only in the last one.
PARTS = 1 << 12


#: Signs of words but digits and the underscore: letters, and number signs like ².
_SIGNS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    words = _SIGNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # few texts have number signs: they part words
    return [w for run in words for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between spaces."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Known:
    """Grams with their log frequencies, a row for each: one dictionary and one matrix."""

    def __init__(self, rows: dict[str, int], scores: np.ndarray):
        self.rows, self.scores = rows, scores

    def get(self, gram: str) -> np.ndarray | None:
        at = self.rows.get(gram)
        return None if at is None else self.scores[at]


class Model:
    """langs in order; words; grams: those of each length, 0 to LONGEST."""

    def __init__(self, langs: list[str], words: Known, grams: list[Known]):
        self.langs, self.words, self.grams = langs, words, grams

    def score(self, word: str) -> np.ndarray:
        """Log frequencies by language, of the word or else of its longest known n-grams (their mean)."""
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(LONGEST, 0, -1):
            rows = self.grams[n].rows
            if found := [rows[g] for g in grams_of(word, n) if g in rows]:
                return np.add.reduce(self.grams[n].scores.take(found, 0), 0) / np.float32(len(found))
        return np.zeros(len(self.langs), np.float32)


_COUNTS = "lang string, gram string, n int, count long"


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n", "count"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole):
            counts: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.update((lang, w, 0) for w in words_of(text))
            yield _rows(counts)


def _grams(words: list[str], langs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """(n, language, grams, counts) of the n-grams of words, each as often as its word; arrays of code points."""
    padded = [f" {w} " for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, sign = np.unique(codes, return_inverse=True)
    if len(alphabet) > 1 << 16:  # four signs have to fit in 64 bits
        half = len(words) // 2
        parts = (slice(None, half), slice(half, None)) if half else ()
        for part in parts:
            yield from _grams(words[part], langs[part], counts[part])
        if not half:
            of = Counter(g for n in range(1, LONGEST + 1) for g in grams_of(words[0], n))
            for n in range(1, LONGEST + 1):
                yield n, int(langs[0]), [g for g in of if len(g) == n], counts[0] * np.array([c for g, c in of.items() if len(g) == n])
        return
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, padded), np.int64, len(words)))
    key = np.zeros(len(sign), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(sign) - n + 1
        key = key[:m] << np.uint64(16) | sign[n - 1 :].astype(np.uint64)
        whole = word[:m] == word[n - 1 :]
        for lang in np.unique(langs).tolist():
            at = np.flatnonzero(whole & (langs[word[:m]] == lang))
            grams, which = np.unique(key[at], return_inverse=True)
            signs = np.stack([alphabet[(grams >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(n - 1, -1, -1)], axis=1)
            yield n, lang, np.ascontiguousarray(signs).view(f"<U{n}").reshape(-1).tolist(), np.bincount(which, weights=counts[word[at]], minlength=len(grams)).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words -> counts of their n-grams; each word is cut once for each length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, langs = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        for n, lang, grams, times in _grams(batch.column("gram").to_pylist(), langs, batch.column("count").to_numpy()):
            k = len(grams)
            yield pa.RecordBatch.from_arrays([pa.array([names[lang]] * k, pa.string()), pa.array(grams, pa.string()), pa.array([n] * k, pa.int32()), pa.array(times, pa.int64())], ["lang", "gram", "n", "count"])


def _chosen(docs: DataFrame, most: int) -> DataFrame:
    """(taken, of): ids and languages of the documents to learn from.

    A language's ids are dealt into parts by hash. Whole parts are taken while they fit; only the part in which the
    number is reached is ranked row by row, so no task sorts a language.
    """
    ids = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).withColumn("part", F.pmod("hash", F.lit(PARTS)))
    sizes = ids.groupBy("lang", "part").agg(F.count("*").alias("size"))
    upto = Window.partitionBy("lang").orderBy("part")
    room = sizes.withColumn("room", most - F.sum("size").over(upto) + F.col("size")).where("room > 0").select("lang", "part", "room", "size")
    held = sized_join(ids, cut(room), ["lang", "part"], "inner")
    last = held.where("size > room").withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy("hash", "doc_id"))).where("place <= room")
    return held.where("size <= room").select("doc_id", "lang").unionByName(last.select("doc_id", "lang")).distinct().select(F.col("doc_id").alias("taken"), F.col("lang").alias("of"))


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """(n, gram): each language's most frequent grams of each length, about ``most`` of them.

    From the histogram of counts: all grams over a count, and of those that have it the share that still fits, by hash.
    """
    classes = counted.groupBy("lang", "n", "count").agg(F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("lang", "n").orderBy(F.desc("count")))
    share = classes.withColumn("share", (most - upto + F.col("size")) / F.col("size")).where("share > 0").select("lang", "n", "count", "share")
    at = F.pmod(F.xxhash64("gram"), F.lit(1 << 30)) / float(1 << 30)
    return sized_join(counted, cut(share), ["lang", "n", "count"], "inner").where(at < F.col("share")).select("n", "gram").distinct()


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, max_words: int | None = None, max_grams: int | None = None) -> Model:
    """docs(doc_id, text, lang, ...) -> Model.

    Every language with labelled rows is learnt, each from max_train documents at most. A word that is kept for one
    language has its real count in all. What reaches the driver is bounded by MAX_WORDS, MAX_GRAMS and MAX_CELLS: from
    51 languages on, each adds fewer words. Rows with a null text or lang teach nothing.
    """
    learn = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    chosen = cut(_chosen(learn, max_train))
    chosen = F.broadcast(chosen) if small_enough(chosen, 500_000) else chosen
    text = learn.join(chosen, F.col("doc_id").eqNullSafe(F.col("taken")) & (F.col("lang") == F.col("of")), "left_semi")
    total = F.sum("count").alias("count")
    words = cut(text.select("lang", "text").mapInArrow(_word_counts, _COUNTS).groupBy("lang", "gram", "n").agg(total))
    grams = cut(words.select("lang", "gram", "count").mapInArrow(_gram_counts, _COUNTS).groupBy("lang", "gram", "n").agg(total))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    at, room = {v: k for k, v in enumerate(langs)}, MAX_CELLS // max(len(langs), 1) ** 2
    found: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    for counted, most in ((words, max_words or MAX_WORDS), (grams, max_grams or MAX_GRAMS)):
        kept = cut(_frequent(counted, min(most, room)))
        rows = sized_join(counted, kept, ["n", "gram"], "left_semi").groupBy("n", "gram").agg(F.collect_list(F.struct("lang", "count")).alias("counts"))
        for r in rows.toLocalIterator():
            found[r["n"]][r["gram"]] = c = np.zeros(len(langs), np.float32)
            for lang, n in r["counts"]:
                c[at[lang]] = n

    def known(held: dict[str, np.ndarray]) -> Known:
        order = sorted(held)
        counts = np.array([held[g] for g in order], np.float64).reshape(len(order), len(langs))
        scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(order)))
        return Known({g: k for k, g in enumerate(order)}, scores.astype(np.float32))

    return Model(langs, known(found[0]), [Known({}, np.zeros((0, len(langs)), np.float32)), *map(known, found[1:])])


class Scorer:
    """A model with the scores of the words that a worker has met; kept from task to task."""

    held: Scorer | None = None

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)), np.float32)

    @classmethod
    def of(cls, model: Model) -> Scorer:
        if cls.held is None or cls.held.model is not model:
            cls.held = cls(model)
        return cls.held

    def _learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > max(REMEMBERED, len(words)):
            self.rows.clear()
        for w in words.difference(self.rows):
            at = self.rows[w] = len(self.rows)
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at] = self.model.score(w)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.langs or not words:
            return "und", 0.0
        if not (distinct := set(words)) <= self.rows.keys():
            self._learn(distinct)
        ids, times = np.unique(np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)), return_counts=True)
        total = times @ self.scores[ids].astype(np.float64)
        best = int(total.argmax())
        mean = total / len(words) * min(len(words), 20)
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, lang_pred, score); `und` and 0 for a text that is null or has no letter.

    score is the share of the likeliest language when the mean scores of up to 20 words are taken as log likelihoods;
    of equal languages the first by name is named. Texts of any length count with all their words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for whole in batches:
            for batch in text_slices(whole):
                found = [scorer.predict(text) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Fits on the rows outside the held-out fold, predicts every row: (doc_id, held_out, lang_pred, score).

    One row for each row of docs, also for those that repeat a doc_id; a null doc_id is never held out. Null texts and
    texts without a letter, empty ones included, are `und`, as are all where no row has a lang. Rows that repeat one
    document teach once for each row. Other columns, whatever their names, are ignored; no rows give no rows.
    """
    out = F.coalesce(bucket(F.col("doc_id"), folds) == held, F.lit(False))
    model = fit(docs.where(~out))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
