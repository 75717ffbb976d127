import re

import numpy as np
import pytest

import corpus_pipeline
from gramtide.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def plain(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, bound=0.8):
    sets, root = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= bound * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in root}


def copies(rng, base, changed):
    """A text with so many of its words replaced, far enough apart that each takes five shingles."""
    words = base.split()
    for k in range(changed):
        words[10 + k * (len(words) - 20) // max(changed, 1)] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {tuple(r) for r in near_copies.groups(df).collect()} == brute(rows)


def test_near_copies_leave_the_pipeline(spark, docs):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        base = " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 500))
        rows += [(10 * k + c, copies(rng, base, 0 if c == 0 else c * 4)) for c in range(6)]
    want = {i for i, root in brute(rows) if i == root}
    assert len(want) < len(rows)
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs(rows), "").collect()} == want


def test_stage_ties_by_simhash(spark, docs, monkeypatch):
    """The stage links the fingerprints of all its sets by deletion variants; these ties hold without any band."""
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: seen.append({r.fp for r in fps.collect()}) or links(fps))
    rng = np.random.default_rng(4)
    base = " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 400))
    rows = [(1, None), (2, base), (3, base.upper()), (4, copies(rng, base, 1)), (5, "a b c")]
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, docs(rows), "").collect()} == {1, 2, 5}
    want = {simhash.fingerprint(t.encode(), 5) for t in (base, rows[3][1], "a b c")}  # shingles of these don't repeat
    assert seen == [{int(np.uint64(v).view(np.int64)) for v in want}]

    fps = [0, 0b1011, 1 << 63, 7 << 40, 7 << 40, (1 << 50) - 1]
    nodes = [(k, int(np.uint64(v).view(np.int64)), [], 9) for k, v in enumerate(fps)] + [(9, 0, [], 0)]
    pairs = near_copies.tied(spark.createDataFrame(nodes, "node long, fp long, bands array<long>, n long")).collect()
    root = list(range(6))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert root == [0, 0, 0, 0, 0, 5]


def test_edge_rows(spark, docs):
    long = "word " * 50_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, long), (8, long + " more"), (9, "a b c d e f"), (9, "a b c d e f")]
    got = [tuple(r) for r in near_copies.groups(docs(rows)).collect()]
    assert len(got) == len(rows) and set(got) == brute(rows[:-1]) | {(1, 1), (2, 1), (3, 1)}
    assert near_copies.groups(docs([])).count() == 0
    assert [tuple(r) for r in near_copies.groups(docs([(None, "a b"), (None, "a b")])).collect()] == [(None, None)] * 2


@pytest.mark.parametrize("bound", [0.8, 0.95])
def test_components_follow_chains(bound):
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 1000, 2, 1002)]
    got = near_copies.verified(sets, bound)
    groups = {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())}
    want = {frozenset({0, 1, 2, 4}), frozenset({3, 5})} if bound == 0.8 else {frozenset({0, 4}), frozenset({1}), frozenset({2}), frozenset({3, 5})}
    assert groups == want


@pytest.mark.parametrize("limits", [(4, 8, 3), (6, 3, 2)])
def test_large_groups_in_blocks(spark, docs, monkeypatch, limits):
    """Groups over the limit: chains whose ends are unlike, stars, and strangers tied by a band, against brute force."""
    for name, value in zip(("GROUP", "BLOCK", "REST_BLOCK"), limits, strict=True):
        monkeypatch.setattr(near_copies, name, value)
    monkeypatch.setattr(near_copies, "PIVOTS", 2)
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for kind in range(3):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)]
        for k in range(14):
            if kind == 0:  # a chain: each step changes a few more words
                words = words[6:] + [f"c{rng.integers(1 << 30)}" for _ in range(6)]
                rows.append((at, " ".join(words)))
            else:
                rows.append((at, copies(rng, " ".join(words), kind * 2 + k % 4)))
            at += 1
    assert {tuple(r) for r in near_copies.groups(docs(rows)).collect()} == brute(rows)
