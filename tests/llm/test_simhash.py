import re

import numpy as np
import pytest
import xxhash

from gramtide.llm import simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {i: plain(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {(i, f"{fps[i]:016x}", find(i)) for i in ids}


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == brute(rows)


def test_edge_rows(spark, docs):
    long = "word " * 200_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, long), (8, long), (9, "Été été a b c d"), (9, "Été été a b c d")]
    got = [tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()]
    assert set(got) == brute(rows[:-1]) and len(got) == len(rows)
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.near_duplicates(docs([(None, "a b"), (None, "a b")])).count() == 2


@pytest.mark.parametrize("limit", [4096, 30])
def test_links_are_complete(spark, limit):
    rng = np.random.default_rng(limit)
    near = np.uint64(0x0123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)], np.uint64)
    fps = np.unique(np.concatenate([near, rng.integers(0, 2**63, 150).astype(np.uint64) << np.uint64(1)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def classes(pairs):
        for k in root:
            root[k] = k
        for a, b in pairs:
            assert (a ^ b & 0xFFFFFFFFFFFFFFFF) is not None
            root[find(a)] = find(b)
        out = {}
        for k in root:
            out.setdefault(find(k), set()).add(k)
        return {frozenset(v) for v in out.values()}

    signed = fps.view(np.int64).tolist()
    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = classes(every)
    assert classes([(r.a, r.b) for r in simhash.links(df, limit).collect()]) == want


def test_hubs_of_a_graph(spark, monkeypatch):
    from gramtide.llm import graph

    monkeypatch.setattr(graph, "HUB", 5)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 12)
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 130)] + [(130, 39), (200, 201)]
    got = {(r.node, r.root) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in [*range(40), *range(100, 131)]} | {(200, 200), (201, 200)}


def test_rows_without_an_id(spark, docs):
    text = "one two three four five six seven eight"
    got = simhash.near_duplicates(docs([(None, text), (None, "other words altogether"), (7, text), (None, text)])).collect()
    assert sorted(((r.doc_id or 0), (r.component_id or 0)) for r in got) == [(0, 0), (0, 7), (0, 7), (7, 7)]
