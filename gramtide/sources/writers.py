"""Writers: the n-gram store, append without repeats, exports that change only when they must."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


def ngram_store(grams: DataFrame, path: str, files: int | None = None) -> None:
    """Partitioned by media, each file a range of grams and sorted by (gram, date): a point query reads few row groups."""
    ranged = grams.repartitionByRange(files, "media", "gram") if files else grams.repartitionByRange("media", "gram")
    ranged.sortWithinPartitions("media", "gram", "date").write.mode("overwrite").partitionBy("media").parquet(path)


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of one version of what ``append_new`` or ``publish_if_changed`` wrote; None if there is nothing."""
    parts = commits.manifest(spark, path, version).get("parts", [])
    return spark.read.parquet(*[commits.data(path, n) for n in parts]) if parts else None


def _write(rows: DataFrame, path: str) -> str:
    name = commits.fresh()
    rows.write.parquet(commits.data(path, name))
    return name


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the stored table doesn't have; returns how many.

    All rows appear with one commit or, after a crash, none. If another writer commits first, its keys are left out too.
    Of rows with one key any stays; keys that are null are equal.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    while True:
        held = commits.manifest(spark, path)
        old = published(spark, path, held["version"])
        fresh = rows
        if old is not None:
            known = old.select([F.col(k).alias(f"__{k}") for k in keys])
            same = [rows[k].eqNullSafe(known[f"__{k}"]) for k in keys]
            fresh = rows.join(known, same, "left_anti")
        fresh = fresh.persist()
        try:
            n = fresh.count()
            if not n or commits.commit(spark, path, held, {"parts": [*held.get("parts", []), _write(fresh, path)]}):
                return n
        finally:
            fresh.unpersist()


def publish_if_changed(rows: DataFrame, path: str) -> bool:
    """Publishes a new version of an export only if its rows, repeats counted, differ from the newest one's.

    The rows are written whole beside the old ones before one commit makes them the export, so readers always find one.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        while True:
            held = commits.manifest(spark, path)
            old = published(spark, path, held["version"])
            same = old is not None and old.schema.simpleString() == rows.schema.simpleString()
            if same and rows.exceptAll(old).isEmpty() and old.exceptAll(rows).isEmpty():
                return False
            if commits.commit(spark, path, held, {"parts": [_write(rows, path)]}):
                return True
    finally:
        rows.unpersist()


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash: what two snapshots must agree on."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash"))
