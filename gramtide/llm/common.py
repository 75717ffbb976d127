"""What the operators of this subpackage share: inputs, the shared folder, cut points of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker takes at once from an Arrow batch; documents may be long.
ROWS_AT_ONCE = 512
#: Bytes of text that a Python worker works on at once.
BYTES_AT_ONCE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a folder of our own is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gramtide-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder of the shared one removed when the process ends."""

    def last() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone
            pass

    atexit.register(last)


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a wide table as Parquet in the shared folder and rereads it; removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gramtide-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that ``stored`` gave and that nothing reads any more."""
    if files := df.inputFiles():
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; counts no further than it must."""
    return df.limit(rows + 1).count() <= rows


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int = 200_000) -> DataFrame:
    """Joins a narrow checkpointed ``right``: broadcast if it has at most ``rows`` rows (checked), else shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that learning and holding out use."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_slices(batch: pa.RecordBatch, column: str = "text"):
    """Zero-copy slices of an Arrow batch that hold at most BYTES_AT_ONCE of text (or one row)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > BYTES_AT_ONCE or i - start >= ROWS_AT_ONCE * 8):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)
