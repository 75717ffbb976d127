"""Readers of article files, lists and stores. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

ARTICLE = "id string, url string, titre string, auteur string, date string, section string, free string, contenu string"
JSONL = "type string, sitemap string, urls array<string>"


def articles_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("date", "contenu"), rejects: bool = False) -> DataFrame:
    """Article rows of CSV files with a header; fields may hold newlines.

    Rows that don't fit are dropped, or with ``rejects`` kept in ``_corrupt_record`` to be counted.
    """
    schema = ARTICLE + (", _corrupt_record string" if rejects else "")
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE" if rejects else "DROPMALFORMED")
    df = reader.option("columnNameOfCorruptRecord", "_corrupt_record").option("columnPruning", False).csv(path) if rejects else reader.csv(path)
    return df if rejects else df.select(*columns)


def normalised(kind: str, df: DataFrame) -> DataFrame:
    """Three archive layouts -> (date, txt): parts (year, month, day, text), headline (headline, text, date_published), plain (date, contenu)."""
    if kind == "parts":
        day, txt = (F.col("year") * 10000 + F.col("month") * 100 + F.col("day")).cast("int"), F.col("text")
    elif kind == "headline":
        day, txt = dates.parse_day(F.col("date_published")), F.concat(F.coalesce("headline", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    elif kind == "plain":
        day, txt = dates.parse_day(F.col("date")), F.col("contenu")
    else:
        raise ValueError(kind)
    return df.select(day.alias("date"), txt.alias("txt")).where("date is not null and txt is not null")


def flatten_jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines {type, sitemap, urls[]} of type ok -> (sitemap, url)."""
    r = lines.select(F.from_json(column, JSONL).alias("r")).where("r.type = 'ok'")
    return r.select("r.sitemap", F.explode("r.urls").alias("url"))


def json_scalar(column: str, path: str) -> Column:
    return F.get_json_object(column, path)
