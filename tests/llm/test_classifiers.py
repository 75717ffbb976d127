import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramtide.llm import knn_quality, langid, quality_rules
from gramtide.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "12 %% 34"), (5, "word " * 100_000), (6, "the the"), (6, "the the"), (None, "no id")]


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_counts_of_the_rules(spark, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + EDGE
    got = quality_rules.verdicts(docs(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    want = sorted(((i or 0), *(c := plain_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)
    assert quality_rules.verdicts(docs([]), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("k,n,delta", [(0, 100, 0.05), (3, 50, 0.01), (40, 41, 0.2), (100, 900, 0.001)])
def test_upper_bound_is_exact(k, n, delta):
    from math import comb

    p = quality_rules.upper_bound(k, n, delta)
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(delta, rel=1e-6)


def test_cutoffs_hold_on_fresh_documents(spark):
    noisy = F.concat(F.repeat(F.lit("word other thing "), 30), F.repeat(F.lit("### "), F.when(F.col("id") % 8 == 0, 60).otherwise(F.when(F.col("id") % 200 == 1, 3).otherwise(0))))
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.md5((i * 7919 + F.col("id")).cast("string").cast("binary")).substr(1, 6)))).alias("w"), F.lit("en").alias("lang"), noisy.substr(511, 400).alias("tail"))
    docs = docs.select("doc_id", F.concat_ws(" ", "w", "tail").alias("text"), "lang").cache()
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 8 == 0, 0).otherwise(1).alias("quality")).where("doc_id < 4000")
    out = quality_rules.verdicts(docs, labels).where("doc_id >= 4000 and not base_failed").groupBy((F.col("doc_id") % 8 == 0).alias("bad")).agg(F.avg((~F.col("kept")).cast("int")).alias("gone")).collect()
    gone = {r.bad: r.gone for r in out}
    assert gone[True] > 0.95 and gone[False] <= quality_rules.ALPHA


def plain_cutoffs(rows, labels):
    """The definition, in Python: rows (doc_id, text, stratum), labels {doc_id: quality}; only the digest is Spark's."""
    texts = {}
    for i, text, stratum, digest, fold in rows:
        if labels.get(i) is not None:
            m = quality_rules.metrics_of((text or "").encode())
            n, chars, symbols, dup, repeat, lines, capitals, marks = m
            if n < 50 or 100 * repeat > 50 * n:
                continue
            shares = {"symbols": symbols / max(n, 1), "repeats": repeat / max(n, 1), "dup_lines": dup / max(lines, 1), "capitals": capitals / max(chars, 1), "marks": marks / max(n, 1)}
            old = texts.get((stratum, digest))
            texts[stratum, digest] = (fold, min(labels[i], old[1]) if old else labels[i], shares)
    strata = {s for s, _ in texts}
    out = {}
    for s in strata:
        for rule in quality_rules.RULES:
            own = [(fold, label, shares[rule]) for (t, _), (fold, label, shares) in texts.items() if t == s]
            sure = [v for fold, label, v in own if fold == 1 and label == 1]
            best = 0.0
            for c in reversed(quality_rules.GRID):
                k = sum(v > c for v in sure)
                if not sure or quality_rules.upper_bound(k, len(sure), quality_rules.DELTA / (len(strata) * 5)) > quality_rules.ALPHA / 5:
                    break
                bad, good = ([v > c for fold, label, v in own if fold == 0 and label == x] for x in (0, 1))
                merit = sum(bad) / max(1, len(bad)) - quality_rules.GOOD_WEIGHT * sum(good) / max(1, len(good))
                if merit > best:
                    best, out[s, rule] = merit, c
    return out


def test_cutoffs_and_verdicts_equal_the_definition(spark):
    """Two strata, bad documents by symbols or capitals, repeated texts and labels that disagree."""
    rng = random.Random(5)
    rows, labels = [], {}
    for i in range(9000):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
        bad = rng.random() < 0.2
        if bad:
            words[:20] = ["##" if i % 2 else "CAPS"] * 20 if rng.random() < 0.8 else words[:20]
            words = rng.sample(words, len(words))
        rows.append((i, " ".join(words), "en" if i % 3 else "fr"))
        labels[i] = int(not bad)
    rows += [(9000 + k, rows[7][1], rows[7][2]) for k in range(30)] + [(None, "x", "en")]
    labels |= {9000 + k: 0 for k in range(30)} | {9100: 1}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels.items(), (1, None), (None, 1)], "doc_id long, quality int")
    told = df.select("doc_id", "text", "lang", F.xxhash64("text"), F.pmod(F.xxhash64(F.xxhash64("text"), F.lit(3)), F.lit(3))).collect()
    want = plain_cutoffs([tuple(r) for r in told], labels)
    metrics = quality_rules.measure(df)
    tried = quality_rules.trials(metrics, known).cache()
    found = quality_rules.cutoffs(tried)
    assert {(r.stratum, r.rule): r.cutoff for r in found.collect()} == want and {("en", "symbols"), ("en", "capitals")} <= want.keys()
    kept = {r.doc_id: (r.kept, r.failed_rules) for r in quality_rules.verdicts(df, known).collect()}
    for i, text, stratum in rows[:2000]:
        n, chars, symbols, dup, repeat, lines, capitals, marks = quality_rules.metrics_of(text.encode())
        shares = {"symbols": symbols / n, "repeats": repeat / n, "dup_lines": dup / lines, "capitals": capitals / chars, "marks": marks / n}
        failed = [r for r in quality_rules.RULES if (stratum, r) in want and shares[r] > want[stratum, r]]
        assert kept[i] == (not failed, failed)
    for r in quality_rules.audit(tried, found).collect():
        assert r.good > 500 and r.rejected <= quality_rules.ALPHA * r.good


def test_false_rejections_on_documents_that_took_no_part(spark):
    """The third fold of the labelled documents at sf0.1, in each language."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    tried = quality_rules.trials(quality_rules.measure(docs), labels).cache()
    for r in quality_rules.audit(tried, quality_rules.cutoffs(tried)).collect():
        assert r.rejected <= quality_rules.ALPHA * r.good


def test_votes_on_held_out_labels(spark, docs):
    out = QUERIES["op4_knn_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) > 0.9 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = knn_quality.classify(docs(EDGE), empty).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = knn_quality.classify(docs(EDGE), some).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert knn_quality.classify(docs([]), some).count() == 0


def test_shapes_are_of_whole_words():
    assert knn_quality._shape("Ab" * 12 + "999") != knn_quality._shape("Ab" * 12)
    assert knn_quality._shape("Hello-WORLD99") == "Xx-X9" and knn_quality._shape("a" * 10**6) == "x"


def test_scores_equal_the_definition(spark, docs):
    """Fit and vote again in plain NumPy, from the sample that the contract names; all rows, one id three times."""
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    twice = next(i for i, _ in table if i in labels and zlib.crc32(str(i).encode()) % 5)
    rows = table + [(twice, dict(table)[twice])] * 2 + EDGE[:3]
    text = dict(table)
    learn = sorted(i for i, q in labels.items() if q is not None and i in text and zlib.crc32(str(i).encode()) % 5)
    terms = [knn_quality._terms(text[i], {}) for i in learn]
    space = knn_quality.fit(terms, [int(labels[i]) for i in learn])
    got = knn_quality.classify(docs(rows), spark.read.parquet(f"{SF}/labels.parquet"), per_label=10**6).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, values = knn_quality._weights(knn_quality._terms(text.get(r.doc_id) or "", {}), space.idf)
        x = values @ space.project[ids]
        cosine = space.vectors @ (x / max(np.linalg.norm(x), 1e-9))
        near = np.argsort(-cosine, kind="stable")[: knn_quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-3).astype(float) ** knn_quality.SHARPNESS
        if r.doc_id not in (1, 2, 3):  # the edge rows share ids with documents
            assert r.score == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=0.02)


def test_block_scores_equal_plain_ones():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space = knn_quality.Space(None, None, v, rng.integers(0, 2, 60).astype(np.float32))
    q = rng.standard_normal((20, 8)).astype(np.float32)
    for x, s in zip(q, knn_quality.score_block(space, q), strict=True):
        cosine = v @ (x / np.linalg.norm(x))
        near = np.argsort(-cosine)[: knn_quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-3).astype(float) ** knn_quality.SHARPNESS
        assert s == pytest.approx((w * space.labels[near]).sum() / w.sum(), rel=1e-4)


def test_languages_of_held_out_documents(spark, docs):
    out = QUERIES["op10_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) > 0.97 * len(out)
    rows = [(i, t, "en" if i else None) for i, t in EDGE] + [(100 + k, "der die das und nicht", "de") for k in range(9)] + [(200 + k, "the and of that with", "en") for k in range(9)]
    got = langid.identify(docs(rows)).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == by[4] == ("und", 0.0) and by[100][0] == "de" and by[200][0] == "en"
    assert {r.lang_pred for r in langid.identify(docs(EDGE[:1] + [(7, "abc", None)])).collect()} == {"und"}
    assert langid.identify(docs([])).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    known = lambda **rows: langid.Known({k.replace("_", " "): i for i, k in enumerate(rows)}, np.array(list(rows.values()), np.float32).reshape(-1, 2))
    model = langid.Model(["a", "b"], known(seen=[-1, -2]), [known(), known(z=[-9, -1]), known(), known(_qu=[-1, -9]), known()])
    assert model.score("seen").tolist() == [-1, -2]
    assert model.score("quz").tolist() == [-1, -9]  # its length-3 gram is known, so shorter ones don't count
    assert model.score("zzz").tolist() == [-9, -1]
    assert model.score("ö").tolist() == [0, 0]


def test_letters_are_the_letters_of_unicode():
    import unicodedata

    every = "".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    got = set("".join(langid.words_of(" ".join(every))))
    assert got == {x for c in every for x in c.lower() if unicodedata.category(x).startswith("L")}


def plain_identify(rows):
    """The definition: counts of words and n-grams, scores word by word."""
    words, grams = {}, {}
    for i, text, lang in rows:
        if text is None or lang is None or (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            continue
        for w in langid.words_of(text):
            words.setdefault(w, Counter())[lang] += 1
            for n in range(1, 5):
                for g in langid.grams_of(w, n):
                    grams.setdefault(n, {}).setdefault(g, Counter())[lang] += 1
    langs = sorted({lang for c in words.values() for lang in c})

    def logs(table):
        totals = {x: sum(c[x] for c in table.values()) + 0.5 * len(table) for x in langs}
        return {g: np.log([(c[x] + 0.5) / totals[x] for x in langs]) for g, c in table.items()}

    words, grams = logs(words), {n: logs(t) for n, t in grams.items()}
    out = []
    for i, text, _ in rows:
        scores = []
        for w in langid.words_of(text):
            known = [words[w]] if w in words else next((f for n in range(4, 0, -1) if (f := [grams[n][g] for g in langid.grams_of(w, n) if g in grams.get(n, {})])), [np.zeros(len(langs))])
            scores.append(np.mean(known, axis=0))
        if not scores or not langs:
            out.append((i or 0, "und", 0.0))
            continue
        total = np.sum(scores, axis=0)
        mean = total / len(scores) * min(len(scores), 20)
        out.append((i or 0, langs[int(total.argmax())], round(float(1 / np.exp(mean - mean.max()).sum()), 4)))
    return sorted(out)


def test_identify_equals_the_definition(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0").select("doc_id", F.substring("text", 1, 500), "lang")
    rows = [tuple(r) for r in table.collect()] + [(i, t, None) for i, t in EDGE] + [(5000, "x² Ⅳ ½ straße İstanbul", "de"), (5001, "q" * 20_000, "en")]
    got = langid.identify(docs(rows)).collect()
    for a, b in zip(sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got), plain_identify(rows), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-3)
