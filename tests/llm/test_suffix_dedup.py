import hashlib
import random

import pytest

from gramtide.llm import suffix_dedup as s


def brute(rows, length=100):
    """rows: (doc_id, text), distinct ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            w = data[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **more):
    return sorted(tuple(r)[:5] for r in s.remove_repeats(df, **more).collect())


@pytest.mark.parametrize("many", [s.MANY_RUNS, 1])
def test_against_brute_force(spark, docs, many):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 50)))
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts.append(p if rng.random() < 0.5 else p[a:b])
        rows.append((i, rng.choice(["", "\n", " "]).join(parts)))
    rows += [(80, None), (81, ""), (82, "x" * 99), (83, "x" * 100), (84, "x" * 101), (85, "y" * 5000), (86, "ab" * 3000), (87, rows[3][1]), (88, rows[3][1])]
    assert got(docs(rows), many_runs=many) == brute(rows)


def test_long_texts_in_segments(spark, docs, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(s, "SEGMENT", 256)  # reaches this process only: the parts are checked here
    import numpy as np

    text = "".join(rng.choice("ab ") for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = {(int(g), int(f) + k) for g, _, f, n in zip(*s._runs(data), strict=True) for k in range(n)}
    parts = set()
    for at in range(0, len(data) - 99, 256):
        parts |= {(int(g), int(f) + at + k) for g, _, f, n in zip(*s._runs(data[at : at + 256 + 99]), strict=True) for k in range(n)}
    assert whole == parts and len(whole) == len(data) - 99
    long = "".join(rng.choice("abcd ") for _ in range(s.SEGMENT + 5000))
    assert got(docs([(1, text * 30), (2, long), (3, "q" + text * 30)])) == brute([(1, text * 30), (2, long), (3, "q" + text * 30)])


def test_repeated_rows_and_null_ids(spark, docs):
    rng = random.Random(6)
    a = "".join(rng.choice("abcdef ") for _ in range(400))
    out = got(docs([(5, a), (5, a), (7, a)]))
    assert [r[2] for r in out] == [0, 0, 400]
    out = s.remove_repeats(docs([(None, a), (7, a)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (7, 400)]
    assert s.remove_repeats(docs([])).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_a_thousand_rows_of_one_id(spark, docs):
    rng = random.Random(7)
    a = "".join(rng.choice("abcdef ") for _ in range(3000))
    out = got(docs([(5, a)] * 1000 + [(4, "q" + a[:500])]))
    assert len(out) == 1001 and out[0][:3] == (4, 501, 0) and {r[:4] for r in out[1:]} == {(5, 3000, 500, 1)}


def test_the_plain_method_gives_the_same(spark, docs):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(260))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(60)) + passage[rng.randint(0, 120) :] + "".join(rng.choice("uvw") for _ in range(k))) for k in range(6)]
    rows += [(6, None), (7, ""), (8, "x" * 150), (9, "ab" * 90), (10, rows[2][1])]
    plain = sorted(tuple(r)[:5] for r in s.doubled(docs(rows)).collect())
    assert plain == brute(rows) == got(docs(rows))


def test_equal_runs_of_a_slice_file_one(spark):
    import numpy as np

    string, whole = np.array([1, 1, 2, 1, 1, 3], np.uint64), np.array([9, 9, 9, 8, 9, 9], np.uint64)
    known, ids, first = np.array([True, True, True, True, False, True]), np.array([4, 2, 1, 1, 0, 1]), np.arange(6)
    filed, repeated = s._first_of_each(string, whole, (known, ids, first))
    assert filed.tolist() == [2, 3, 4, 5] and repeated.tolist() == [0, 1]  # the null id is the least
    filed, repeated = s._first_of_each(string[:2], whole[:2], (known[:2], np.array([4, 4]), np.zeros(2, int)))
    assert len(filed) == 1 and not len(repeated)  # rows at one place
