"""The corpus pipeline: documents -> quality rules -> line dedup -> near-dedup -> mix -> SentencePiece ids.

Each stage is (name, function of (session, docs, folder)); what it returns is written as Parquet and reread as the
next one's docs. All stages but the last return the columns of documents. Every stage works on all that the one
before kept and calls one operator of ``gramtide.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramtide.llm import line_dedup, mixing, near_copies, pieces, quality_rules
from gramtide.llm.common import cut, stored, table
from gramtide.llm.queries import TOKENIZERS

#: The pipeline keeps clean documents: the mix may use this share of what is left, so that only sources that are
#: over their target weight lose documents. No document is taken twice.
BUDGET_SHARE, MAX_EPOCHS = 0.9, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts among them.

    Verdicts are by doc_id; rows that repeat one share the strictest, also those without a doc_id. Texts of any length
    are whole; columns beyond those of documents stay. An empty table stays empty. Without labels only the base rules count.
    """
    verdict = quality_rules.verdicts(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.min("kept").alias("stays"))
    return _with(docs, verdict.where("stays").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over ten sources or more go; n_chars follows the text.

    All rows stay: null texts as they are, others with what is left of them, even if that is nothing. Rows that repeat
    a doc_id are cleaned each for itself. An empty table stays empty; a null source is no source.
    """
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays: the one with the smallest id.

    Texts without words, null ones included, are one group. All rows that repeat the id that stays do so; a null id stays
    only where its group has no other. An empty table stays empty. Candidates are what SimHash links by its deletion
    variants, and what MinHash bands add where 4 bits are too few (see ``near_copies``); every similarity is taken exactly.
    """
    found = near_copies.groups(docs)
    return _with(docs, found.where("doc_id <=> component_id").select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix doesn't take go, texts without words among them.

    Rows that repeat a doc_id stay or go together if their texts lie in one leaf. Null languages and sources are leaves
    of their own; an empty table stays empty; a null doc_id is a document like any other.
    """
    return _with(docs, mixing.selection(mixing.leaves(docs), BUDGET_SHARE, max_epochs=MAX_EPOCHS).select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every row: null and empty texts have no ids; other columns go."""
    return pieces.encoded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


def _with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids, each once for each of its rows."""
    return docs.join(cut(ids).withColumnRenamed("doc_id", "__taken"), F.col("doc_id").eqNullSafe(F.col("__taken"))).select(*docs.columns)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near), ("mix", mix), ("encode", encode)]

#: The verdicts of the rules, the links and the ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stored(docs)
    return docs
