import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramtide.llm import pieces, token_counts
from gramtide.llm.queries import CUT, END_OF_DOCUMENT, QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(MODEL)


def test_random_texts_equal_the_library(vocabulary, library):
    rng = random.Random(1)
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    for k in range(600):
        text = "".join(rng.choice("abctheingon  \n▁éß日x1290._-=é\U0001f600\0\t") for _ in range(rng.randint(0, 150)))
        text = text.replace(" ", "") if k % 3 == 0 else text
        want, at = library.encode(text), rng.randint(0, len(text))
        assert encoder.encode(text) == want and list(encoder.stream([text[:at], text[at:]])) == want
        assert decoder.decode(want) == library.decode(want) == "".join(decoder.stream(want))


@pytest.mark.parametrize("stretch", ["theinternationalization", "ab", "日本", "\0"])
def test_the_window_is_bounded(vocabulary, library, stretch):
    text = stretch * 20_000
    encoder = pieces.Encoder(vocabulary)
    ids = list(encoder.stream(text[at : at + 700] for at in range(0, len(text), 700)))
    assert ids == library.encode(text) and encoder.window.fed == len(text) + 1 and encoder.window.widest < 200


def test_every_sign_goes_through_the_steps(vocabulary, library):
    """By the lanes, by the window alone, and as one stream: the same ids, and all signs counted."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()][:200]
    want = [library.encode(t) for t in texts]
    encoder = pieces.Encoder(vocabulary)
    assert list(encoder.encode_all(texts)) == want
    distinct = {run for t in texts for run in encoder.runs(t)}
    assert encoder.lanes.fed + encoder.window.fed >= sum(map(len, distinct))
    alone = pieces.Encoder(vocabulary)
    alone.learn = lambda runs: None
    assert list(alone.encode_all(texts)) == want
    assert alone.lanes.fed == 0 and alone.window.fed == sum(len(run) for t in texts for run in alone.runs(t)) >= sum(map(len, texts))
    assert [list(alone.stream([t])) for t in texts] == want


def test_lanes_equal_the_window(vocabulary):
    rng = random.Random(3)
    runs = ["".join(rng.choice("abcdefinorst▁,.'AÉß19") for _ in range(rng.randint(0, 48))) for _ in range(2000)]
    runs = [r for r in runs if vocabulary.characters.issuperset(r)]
    window = pieces.Viterbi(vocabulary)
    assert pieces.Lanes(vocabulary).encode(runs) == [tuple(window.feed(r, last=True)) for r in runs]
    assert pieces.Lanes(vocabulary).encode([]) == []


def test_documents_round_trip(spark, docs, library):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    out = QUERIES["op7_sentencepiece"](spark, SF)
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
    assert {(r.doc_id, r.text) for r in pieces.decoded(out, MODEL).collect()} == set(texts.items())
    long = "word" * 50_000
    rows = [(1, None), (2, ""), (3, long), (4, " "), (4, " "), (None, "a")]
    got = pieces.encoded(docs(rows), MODEL).collect()
    assert sorted((r.doc_id or 0, r.ids == library.encode(dict(rows)[r.doc_id] or "")) for r in got) == [(0, True), (1, True), (2, True), (3, True), (4, True), (4, True)]
    assert pieces.encoded(docs([]), MODEL).count() == 0


def test_token_counts_of_documents(spark):
    tokenizer = token_counts._tokenizer(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", CUT)
    want = {r.doc_id: len(tokenizer.encode_ordinary(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, SF).collect()} == want


@pytest.mark.parametrize("block,width", [(2, 2), (10, 2), (64, 4), (1 << 20, 4)])
def test_scan_of_files(spark, tmp_path, block, width):
    rng, want = np.random.default_rng(block), []
    for k in range(4):
        lengths = rng.integers(0, 40, 50)
        tokens = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in lengths] + [rng.integers(0, 9, k)])
        tokens.astype(f"<u{width}").tofile(tmp_path / f"{k}.bin")
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        want += [(f"{k}.bin", i, int(s), int(n), True) for i, (s, n) in enumerate(zip(starts, lengths, strict=False))] + ([(f"{k}.bin", 50, int(starts[-1]), k, False)] if k else [])
    (tmp_path / "empty.bin").touch()
    got = token_counts.scan(token_counts.blocks_of(spark, str(tmp_path), block), 9, width, block).collect()
    assert sorted(tuple(r) for r in got) == want


def test_one_file_is_the_work_of_many_tasks(spark, tmp_path):
    """A file of more blocks than any task takes, one document over many blocks; blocks are read by place."""
    tokens = np.ones(50_000, "<u2")
    tokens[[10, 40_000]] = 9
    tokens.tofile(tmp_path / "a.bin")
    blocks = token_counts.blocks_of(spark, str(tmp_path), 1000)
    assert blocks.count() == 100
    assert token_counts.summaries(blocks, 9, 2, 1000).groupBy(F.input_file_name()).count().count() > 4
    got = sorted(tuple(r) for r in token_counts.scan(blocks, 9, 2, 1000).collect())
    assert got == [("a.bin", 0, 0, 10, True), ("a.bin", 1, 11, 39_989, True), ("a.bin", 2, 40_001, 9_999, False)]


def test_the_query_reads_flat_files_only(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/flat"
    rows = [(k, "some words " * k) for k in range(40)]
    manifest = token_counts.write_files(docs(rows).repartition(3), folder, RANKS, CUT, END_OF_DOCUMENT)
    assert {p.suffix for p in (tmp_path / "flat").iterdir() if not p.name.startswith(".")} == {".bin"}
    held = np.concatenate([np.fromfile(p, "<u2") for p in (tmp_path / "flat").glob("*.bin")])
    assert (held == END_OF_DOCUMENT).sum() == 40
    found = token_counts.scan(token_counts.blocks_of(spark, folder, 64), END_OF_DOCUMENT, 2, 64)
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(manifest, found).collect()}
    tokenizer = token_counts._tokenizer(RANKS, CUT)
    assert got == {k: len(tokenizer.encode_ordinary(t)) for k, t in rows}
    next((tmp_path / "flat").glob("*.bin")).unlink()
    with pytest.raises(ValueError):
        token_counts.counts(manifest, token_counts.scan(token_counts.blocks_of(spark, folder, 64), END_OF_DOCUMENT, 2, 64))


def test_token_files_edge_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "a" * 100_000), (4, "hi"), (4, "hi"), (None, "x y")]
    got = token_counts.documents_counts(docs(rows).coalesce(1), RANKS, CUT, END_OF_DOCUMENT).orderBy("ordinal").collect()
    tokenizer = token_counts._tokenizer(RANKS, CUT)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, len(tokenizer.encode_ordinary(t or ""))) for i, t in rows]
    assert token_counts.documents_counts(docs([]), RANKS, CUT, END_OF_DOCUMENT).count() == 0


def test_sentencepiece_answers_are_bytes_and_decode_as_the_stream(vocabulary):
    """What is remembered is no object that the garbage collector walks; whole texts decode as streams do."""
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    text = "a naïve line\n\tof 漢字 and 🜁🜂, twice: a naïve line\n"
    ids = encoder.encode(text)
    assert encoder and all(type(v) is bytes for v in encoder.values()) and decoder.decode(ids) == text
    special, words = sorted(vocabulary.special), encoder.encode("x of the")
    of = lambda *b: [vocabulary.byte_ids[x] for x in b]
    for odd in ([special[0], *words], [*of(0xE2), special[0], *of(0x82, 0xAC)], [*of(0xE2, 0x82, 0xAC), *words], of(0x20, 0x0A), [*of(0xE2, 0x82), *words], []):
        assert decoder.decode(odd) == "".join(decoder.stream(odd))
