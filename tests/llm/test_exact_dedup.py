import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramtide.llm import exact_dedup as x


def brute(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return sorted((i, max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_edge_rows(spark, docs):
    long = "é" * 150_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long[:-1] + "e"), (8, "b"), (8, "b"), (9, "b ")]
    assert sorted(tuple(r) for r in x.exact_groups(docs(rows)).collect()) == brute(rows)
    assert x.exact_groups(docs([])).count() == 0
    got = x.exact_groups(docs([(None, "a"), (1, "a"), (None, "q")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 1, 2, False), (1, 1, 2, True)]


@pytest.mark.parametrize("strip", [1 << 18, x.CHUNK])
def test_equal_fingerprints_of_different_texts_are_told_apart(spark, docs, monkeypatch, strip):
    monkeypatch.setattr(x, "PRIMES", (1, 1))  # all hashes are 0
    far = "a" * 20_000
    rows = [(1, "ab"), (2, "ab"), (3, "ba"), (4, "cc"), (5, far + "x"), (6, far + "y"), (7, far + "x")]
    assert sorted(tuple(r) for r in x.exact_groups(docs(rows), strip).collect()) == brute(rows)


def test_strips_give_the_whole_fingerprint(spark, docs):
    rows = [(k, chr(97 + k) * n) for k, n in enumerate((0, 1, x.CHUNK, x.CHUNK + 1, 5 * x.CHUNK, 9 * x.CHUNK + 77))] + [(3, "d" * (x.CHUNK + 1)), (3, "é" * x.CHUNK)]
    got = x.fingerprints(docs(rows).select("doc_id", "text"), x.CHUNK).collect()
    assert sorted((r.doc_id, r.n, r.fp) for r in got) == sorted((i, len(t.encode()), x.fingerprint(t.encode())) for i, t in rows)


def test_a_task_compares_what_it_meets(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"fp": [1, 1, 1, 2], "n": [2] * 4, "place": [0, 0, 0, 0], "text": [b"ab", b"ab", b"ba", b"ab"]})
    for held in (1 << 20, 0):
        got = [r for b in x._met(held)(iter([batch, batch])) for r in b.to_pylist()]
        assert any(r["differ"] for r in got if r["fp"] == 1) and not any(r["differ"] for r in got if r["fp"] == 2) and {r["fp"] for r in got} == {1, 2}


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3 * x.CHUNK), st.integers(0, 3 * x.CHUNK))
def test_fingerprints_combine(data, at):
    at = min(at, len(data))
    for which in (0, 1):
        whole = 0
        for byte in data:
            whole = (whole * x.BASES[which] + byte) % x.PRIMES[which]
        parts = []
        for piece in (data[:at], data[at:]):
            now = (0, 0)
            for k in range(0, len(piece), x.CHUNK):
                h = x.chunk_hashes(__import__("numpy").frombuffer(piece[k : k + x.CHUNK], "u1"), which)
                now = x.combine(now, (int(h[0]), len(piece[k : k + x.CHUNK])), which)
            parts.append(now)
        assert x.combine(*parts, which)[0] == whole
    assert x.fingerprint(data) == x.fingerprint(data, x.CHUNK)
