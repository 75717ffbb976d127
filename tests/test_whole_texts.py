"""Queries read every text whole: long, short and null ones."""

import re

import pytest

from gramtide.functions import text
from gramtide.plans import catalog

TEXTS = {1: "Wörter the M. Müller  of " * 200 + "end", 2: "x" * 41 + " tail", 3: "short one", 4: None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, "user", "ask"), (1, 2, "bot", "long " * 20 + "end")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def plain_tokens(t):
    return re.findall("[a-zà-ÿ0-9']+", re.sub(r"([A-Z])\.", r"\1", t).lower().replace("’", "'"))


def bare(t):
    return re.sub(r"\s+", "_", t.strip().lower().translate(str.maketrans("öü", "ou")))


def plain_clean(t):
    return " ".join(w for w in re.findall("[a-zà-öø-ÿœæ]+", t.lower()) if len(w) >= 3 and w not in text.STOP_WORDS)


@pytest.mark.parametrize("name,want", [("tokenize_query", plain_tokens), ("clean_text", plain_clean), ("squash_ws", lambda t: re.sub(r"\s+", " ", t).strip()), ("slug", bare)])
def test_each_text_whole(spark, folder, name, want):
    got = {r[0]: r[1] for r in catalog.QUERIES[name](spark, folder).collect()}
    assert got == {i: None if t is None else want(t) for i, t in TEXTS.items()}


def test_section_lines_whole(spark, folder):
    assert [r.lines for r in catalog.QUERIES["section_lines"](spark, folder).collect()] == ["long " * 20 + "end"]


def test_scan_counts_long_articles(spark, folder):
    assert sum(r.chars for r in catalog.QUERIES["scan_articles"](spark, folder).collect()) == sum(len(t) for t in TEXTS.values() if t)
