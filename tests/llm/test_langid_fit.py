import numpy as np

from gramtide.llm import langid


def test_every_language_is_learnt(docs):
    name = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(k, f"{name(k) * 3} {name(k) * 4}", f"l{k}") for k in range(60)]
    df = docs(rows)
    model = langid.fit(df)
    assert model.langs == sorted(f"l{k}" for k in range(60))
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {k: f"l{k}" for k in range(60)}


def test_a_rare_language_is_learnt_beside_a_hot_one(docs):
    rows = [(k, "the and of", "en") for k in range(200)] + [(1000, "mitt hus", "sv"), (None, "suuri talo", "fi")]
    assert langid.fit(docs(rows), max_train=5).langs == ["en", "fi", "sv"]


def test_kept_words_have_their_real_counts(docs):
    words = langid.fit(docs([(1, "x x x y y", "a"), (2, "y y y x x", "b")]), max_words=1).words
    assert set(words.rows) == {"x", "y"}
    assert np.allclose(words.get("x"), np.log([3.5 / 6, 2.5 / 6])) and np.allclose(words.get("y"), np.log([2.5 / 6, 3.5 / 6]))


def test_documents_are_chosen_by_hash(docs, monkeypatch):
    rows = [(k, f"w{chr(97 + k % 26)}", "en" if k % 7 else "fr") for k in range(500)]
    for parts in (1, 16, 4096):
        monkeypatch.setattr(langid, "PARTS", parts)
        got = langid._chosen(docs(rows), 30).groupBy("of").count().collect()
        assert {r.of: r["count"] for r in got} == {"en": 30, "fr": 30}


def test_grams_of_words_equal_the_plain_ones():
    from collections import Counter

    rng = np.random.default_rng(1)
    words = ["".join(chr(c) for c in rng.integers(97, 103, n)) for n in rng.integers(1, 9, 200)] + ["é日🙂x", "q" * 5000, "".join(chr(c) for c in range(0x4E00, 0x4E00 + 70_000) if not 0xD800 <= c < 0xE000)]
    langs, counts = rng.integers(0, 3, len(words)), rng.integers(1, 9, len(words))
    want = Counter()
    for w, lang, times in zip(words, langs.tolist(), counts.tolist(), strict=True):
        for n in range(1, 5):
            for g in langid.grams_of(w, n):
                want[n, lang, g] += times
    got = Counter()
    for n, lang, grams, times in langid._grams(words, langs, counts):
        for g, c in zip(grams, times.tolist(), strict=True):
            got[n, lang, g] += c
    assert got == want
