"""Articles of pages by the rules of their media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import selectors
from .lineage import sized_join


def by_rules(pages: DataFrame, rules: DataFrame, html: str = "html") -> DataFrame:
    """pages(media, html, ...) + rules(media, strategy, body, titre, auteur, date) -> the pages' columns but for the html, and
    ``article``, a struct.

    A rule for each medium: the smaller of two stays. What a rule leaves null, and media without one or that are null,
    take ``selectors.DEFAULT``.
    """
    names = list(selectors.DEFAULT)
    one = rules.groupBy("media").agg(F.min(F.struct(*names)).alias("__rule"))
    rows = sized_join(pages, one, "media", "left")
    filled = [F.coalesce(F.col(f"__rule.{n}"), F.lit(v)) for n, v in selectors.DEFAULT.items()]
    return rows.withColumn("article", selectors.by_rule(html, *filled)).drop(html, "__rule")
