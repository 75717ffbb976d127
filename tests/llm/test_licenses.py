import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramtide.llm import licenses as x

LOWER = {k: k + 32 for k in range(65, 91)}


def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_base(text):
    w = brute_words(text)
    return sorted((k, label) for phrase, label in x.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())


def has(texts, run):
    return any(t[k : k + len(run)] == run for t in texts for k in range(len(t) - len(run) + 1))


def brute_matches(texts, w, least):
    """(start, place, length, text): every run up to a word, the longest that any text has, where it doesn't go on."""
    out, start = set(), 0
    for k in range(len(w)):
        while start <= k and not has(texts, w[start : k + 1]):
            start += 1
        run = w[start : k + 1]
        if len(run) < least:
            continue
        for number, t in enumerate(texts):
            for at in range(len(t) - len(run) + 1):
                if t[at : at + len(run)] == run:
                    longer = k + 1 < len(w) and has(texts, w[start : k + 2])  # else the run itself ends here
                    if not (longer and t[at + len(run) : at + len(run) + 1] == [w[k + 1]]):
                        out.add((start, at, len(run), number))
    return out


def scanner(templates, **options):
    return x.Scanner([("l" + str(k), " ".join(t)) for k, t in enumerate(templates)], [("zz zz", "zz")], **options)


LETTERS = st.lists(st.sampled_from("abc"), min_size=1, max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.sampled_from([3, 7, 1 << 20]))
def test_matches_equal_brute_force(templates, w, block):
    s = scanner(templates, min_match=2)
    got = set()
    keep = x.Chains._chain
    try:
        x.Chains._chain = lambda self, m: got.add(tuple(m))
        n, _, _ = s.scan(" ".join(w).encode(), block)
    finally:
        x.Chains._chain = keep
    assert n == len(w)
    # a match that one place of a text continues to the left of another is the run's, as the run is the longest
    assert got == brute_matches(templates, w, 2)


def brute_cover(templates, w, least, gap):
    """The most words of each text that a chain of matches covers, over all chains."""
    best = {}
    for number in range(len(templates)):
        ms = sorted((m for m in brute_matches(templates, w, least) if m[3] == number), key=lambda m: (m[0] + m[2], m[0], m[1]))
        ends = {}
        for i, (s, a, n, _) in enumerate(ms):
            ends[i] = n
            for j in range(i):
                ps, pa, pn, _ = ms[j]
                over = max(0, ps + pn - s, pa + pn - a)
                if s - (ps + pn) <= gap and over < n and ps < s and pa < a:
                    ends[i] = max(ends[i], ends[j] + n - over)
        best[number] = max(ends.values(), default=0)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=3), st.lists(st.sampled_from("abcd"), max_size=24), st.integers(0, 6))
def test_chains_cover_what_all_chains_do(templates, w, gap):
    s = scanner(templates, min_match=2, max_gap=gap, min_share=0.01)
    _, _, spans = s.scan(" ".join(w).encode())
    got = {}
    for span in spans:
        got[span.text] = max(got.get(span.text, 0), span.covered)
        assert 0 <= span.first <= span.last < len(w)
    assert got == {k: v for k, v in brute_cover(templates, w, 2, gap).items() if v}


def test_edge_rows(spark, docs):
    mit = x.TEMPLATES[6][1]
    long = "wort " * 400_000 + "GNU  General-Public\tLicense" + " é" * 300_000
    rows = [
        (1, None), (2, ""), (3, "..."), (4, "Released under the MIT License. MIT license, CC-BY"), (4, "Released under the MIT License. MIT license, CC-BY"),
        (None, "mit license"), (5, mit), (6, mit.replace(" and ", " und ").upper()), (7, long), (8, "mitlicense ccby gnu general public licenses"), (9, "cc by cc by"), (10, "mit\x00license \x7f x" * 3),
    ]
    got = x.scan(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, text in rows:
        places, r = brute_base(text), by[i]
        assert (r.n_words, r.n_base) == (len(brute_words(text)), len(places)), i
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert by[1].labels == by[2].labels == by[3].labels == by[8].base_labels == "" and by[1].score == 0
    assert by[5].base_labels == "" and by[5].labels == "mit" and by[5].score == 1 and by[5].spans[0].first_word == 0
    assert by[6].labels == "mit" and 0.5 <= by[6].score < 1
    assert by[7].base_labels == "gpl" and by[7].first_word == 400_000
    assert x.scan(docs([])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    from gramtide.llm.queries import QUERIES

    path = f"/root/testdata/{sf}"
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_licenses"](spark, path).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == set(want)
    assert any(r.n_base for r in got)
    for r in got:
        places = brute_base(want[r.doc_id])
        assert r.n_words == len(brute_words(want[r.doc_id])) and r.n_base == len(places)
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert (r.score == 1) >= bool(places) and 0 <= r.score <= 1
