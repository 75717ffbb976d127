"""Token counts of the documents in flat token files, by a scan for separators.

A flat token file is nothing but token ids of 2 or 4 bytes, each document followed by an end-of-document id; no index
says where documents begin. Files are cut into blocks without regard to documents, so one file is the work of many
tasks: each opens the file, seeks to its block and searches it for separators at once, as an array. A prefix scan
over the blocks' summaries (tokens, separators, place of the last separator) then stitches the documents that cross
blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, removed_at_exit, shared_dir, sized_join, stored, text_slices

#: Bytes of a block.
BLOCK = 1 << 20
#: Blocks of a task, about, where there are more of them than cores.
TASK_BLOCKS = 64
#: Bytes that a writer holds before it writes them.
WRITE_BYTES = 4 << 20


def _opened(path: str):
    """(file system, path in it) of a folder or file: any that Arrow knows by its address, else a local path."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _tokenizer(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_files(docs: DataFrame, folder: str, ranks_path: str, pattern: str, eod: int, width: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) -> manifest (file, ordinal, doc_id); writes one flat file ``part-NNNNNN.bin`` a partition.

    The folder must be one that all executors share. A null text counts as empty: a separator alone. Rows that repeat
    a doc_id are documents of their own; other columns, whatever their names, are ignored; no rows give no files. A
    file is written under a name of its own and renamed when it is whole, so a task that is repeated after the loss of
    its executor leaves the same file; the docs must be rows as stored, which come in the same order again.
    """
    if eod >= 1 << 8 * width:
        raise ValueError("the end-of-document id does not fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, tokenizer, ordinal, held = f"part-{TaskContext.get().partitionId():06d}.bin", None, 0, bytearray()
        system, path = _opened(folder)
        sink, own = None, f"{path}/.{file}-{uuid.uuid4().hex}"
        for whole in batches:
            for batch in text_slices(whole):
                if sink is None and batch.num_rows:
                    system.create_dir(path, recursive=True)
                    sink, tokenizer = system.open_output_stream(own), _tokenizer(ranks_path, pattern)
                for text in batch.column("text").to_pylist():
                    held += np.array([*tokenizer.encode_ordinary(text or ""), eod], f"<u{width}").tobytes()
                    if len(held) >= WRITE_BYTES:
                        sink.write(bytes(held))
                        held.clear()
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                ordinal += n
        if sink is not None:
            sink.write(bytes(held))
            sink.close()
            system.move(own, f"{path}/{file}")

    return stored(docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long"))


def blocks_of(spark: SparkSession, folder: str, block: int = BLOCK, names: str = "*.bin") -> DataFrame:
    """(file, path, seq, size): the blocks of a folder's flat files; only names and lengths are read here.

    Files are of any length. ``block`` is a multiple of the width of a token.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "length").where("length > 0")
    places = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")).alias("seq"))
    return places.select("file", "path", "seq", F.least(F.lit(block), F.col("length") - F.col("seq") * block).cast("long").alias("size"))


def summaries(blocks: DataFrame, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """blocks(file, path, seq, size) -> (file, seq, n, seps), stored: tokens and places of the separators of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, seq, size in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "seq", "size")), strict=True):
                system, at = _opened(path)
                with system.open_input_file(at) as source:
                    data = source.read_at(size, seq * block)
                tokens = np.frombuffer(data, f"<u{width}")
                found = pa.array([np.flatnonzero(tokens == eod)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([seq], pa.int64()), pa.array([len(tokens)], pa.int64()), found], ["file", "seq", "n", "seps"])

    # a number of tasks of its own: ranges are few bytes, which adaptive execution would gather in one task
    total, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    dealt = blocks.repartition(max(1, min(total, max(2 * cores, total // TASK_BLOCKS))), "file", "seq")
    return stored(dealt.mapInArrow(run, "file string, seq long, n long, seps array<long>"))


def scan(blocks: DataFrame, eod: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """blocks(file, path, seq, size) -> (file, ordinal, start, n_tokens, ended), one row for each document.

    ordinal counts from 0 in a file, start is the document's first token, n_tokens is without the separator. Tokens
    after a file's last separator form a document that has not ``ended``. The blocks of a file hold whole tokens.
    """
    scanned = summaries(blocks, eod, width, block)
    # the prefix scan sees one narrow row for each block; separators stay where they are
    narrow = scanned.select("file", "seq", "n", F.size("seps").cast("long").alias("k"), F.when(F.size("seps") > 0, F.element_at("seps", -1)).alias("sep"))
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("last", F.col("offset") + F.col("sep"))
    placed = stored(placed.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("carry", F.coalesce(F.last("last", True).over(before), F.lit(-1))))
    ends = sized_join(scanned.where(F.size("seps") > 0).select("file", "seq", "seps"), placed.select("file", "seq", "base", "offset", "carry"), ["file", "seq"], "inner")
    ends = ends.select("file", "base", "offset", "carry", "seps", F.posexplode("seps").alias("at", "sep"))
    start = F.when(F.col("at") == 0, F.col("carry") + 1).otherwise(F.col("offset") + F.element_at("seps", F.greatest("at", F.lit(1))) + 1)
    whole = ends.select("file", (F.col("base") + F.col("at")).alias("ordinal"), start.cast("long").alias("start"), (F.col("offset") + F.col("sep") - start).cast("long").alias("n_tokens"), F.lit(True).alias("ended"))
    total = placed.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = total.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def counts(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """manifest(file, ordinal, doc_id), found: what ``scan`` gives -> (doc_id, file, ordinal, start, n_tokens).

    One row for each row of the manifest. Files with more or fewer documents than the manifest says are an error.
    """
    named = manifest.groupBy("file").agg(F.count("*").alias("named"))
    ended = found.groupBy("file").agg(F.count_if("ended").alias("ended"), F.count("*").alias("all"))
    wrong = named.join(ended, "file", "full").where("not (named <=> ended and ended <=> all)").limit(3).collect()
    if wrong:
        raise ValueError(f"files that don't hold the documents of their manifest: {wrong}")
    return manifest.join(found, ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens")


def documents_counts(docs: DataFrame, ranks_path: str, pattern: str, eod: int, width: int = 2) -> DataFrame:
    """Writes the documents as flat files in the shared folder, scans the files, names what is found."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/gramtide-flat-{uuid.uuid4().hex}"
    manifest = write_files(docs, folder, ranks_path, pattern, eod, width)
    if not manifest.limit(1).count():
        return manifest.select("doc_id", "file", "ordinal", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    removed_at_exit(spark, folder)
    found = stored(scan(blocks_of(spark, folder), eod, width))
    remove(spark, folder)  # the counts are stored, so no later task asks for the files
    return counts(manifest, found)
