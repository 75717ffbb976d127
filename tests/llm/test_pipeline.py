import pytest

import corpus_pipeline as p
from gramtide.llm import mixing, pieces, quality_rules
from gramtide.llm.queries import TOKENIZERS
from tests.llm.test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    kept = stages["quality rules"](spark, docs, SF)
    verdict = quality_rules.verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept")
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdict.collect()}

    lined = stages["line dedup"](spark, kept, SF)
    rows = kept.collect()
    sites = {}
    for r in rows:
        for line in set(r.text.split("\n")):
            if line.strip():
                sites.setdefault(line, set()).add(r.source)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(sites.get(x, ())) < 10) for r in rows}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == docs.columns

    near = stages["near-dedup"](spark, lined, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, root in brute(list(want.items())) if i == root)

    mixed = stages["mix"](spark, near, SF)
    assert mixed.columns == docs.columns and mixed.exceptAll(near).count() == 0 and 0.5 * near.count() < mixed.count() <= near.count()
    taken = {r.doc_id for r in mixing.selection(mixing.leaves(near), p.BUDGET_SHARE, max_epochs=1).collect()}
    assert {r.doc_id for r in mixed.collect()} == taken

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in mixed.collect()}
    coded = {r.doc_id: (list(r.ids), r.n_tokens, r.round_trip) for r in p.run(spark, SF).collect()}
    assert coded == {i: (library.encode(t), len(library.encode(t)), True) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in pieces.decoded(p.run(spark, SF), f"{TOKENIZERS}/piece_bpe_32k.model").collect()} == texts


#: A clean text of 60 different words, and another.
CLEAN, OTHER = (" ".join(f"{a}{b}" for a in x for b in "bcdfghjklmnp") for x in ("aeiou", "rstvw"))
LONG = " ".join(f"w{k}" for k in range(60_000))
ROWS = [(1, None), (2, ""), (3, CLEAN), (3, CLEAN), (None, OTHER, "en", "s"), (5, "x " * 300), (6, LONG, "fr", "s1"), (7, CLEAN.upper()), (8, "a b")]
#: What each stage leaves of ROWS: the doc_ids.
LEAVES = {
    "quality rules": [None, 3, 3, 6, 7],  # null, empty, repetitive and short texts go
    "line dedup": [None, 1, 2, 3, 3, 5, 6, 7, 8],
    "near-dedup": [None, 1, 3, 3, 5, 6, 8],  # 2 is like 1, 7 like 3
    "mix": None,
    "encode": [None, 1, 2, 3, 3, 5, 6, 7, 8],
}


@pytest.mark.parametrize("name", LEAVES)
def test_edge_rows(spark, docs, name, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, stage = docs(ROWS), dict(p.STAGES)[name]
    out = stage(spark, table, str(tmp_path))
    got = sorted((r.doc_id for r in out.collect()), key=lambda i: -1 if i is None else i)
    if name == "mix":  # a document that is larger than what its leaf may use (6) goes
        want = mixing.selection(mixing.leaves(table), p.BUDGET_SHARE, max_epochs=1).collect()
        assert got == sorted((r.doc_id for r in want), key=lambda i: -1 if i is None else i) and set(got) <= {None, 3, 5, 6, 7, 8} and {None, 3} <= set(got)
    else:
        assert got == LEAVES[name]
    if name == "encode":
        assert {(r.doc_id, r.n_tokens > 0, r.round_trip) for r in out.collect()} == {(i, bool(t), True) for i, t, *_ in ROWS}
    else:
        assert out.columns == table.columns
        texts = {(r[0], r[1] or None) for r in ROWS}
        assert {(r.doc_id, r.text or None) for r in out.collect()} <= texts
    assert stage(spark, docs([]), str(tmp_path)).count() == 0
