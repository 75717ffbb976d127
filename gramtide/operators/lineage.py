"""Cut points of lineage in the folder that a cluster shares, and joins that broadcast by a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on one machine, where that is unset, a folder of our own."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = found or tempfile.mkdtemp(prefix="gramtide-")
    if held.isEmpty():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; what is in it goes when the process ends."""
    path = f"{shared_dir(spark)}/gramtide/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone
            pass

    atexit.register(remove)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what is used more than once is made once, and a lost executor doesn't make it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows; counts no further than it must."""
    return df.limit(rows + 1).count() <= rows


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a narrow ``right``: broadcast if it has at most ``rows`` rows, else shuffled."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)
