"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree domain > language > source. A token budget flows down by weight; a node that has too
few tokens (its tokens times ``max_epochs``) gives its shortage to its siblings, and only what no sibling can take
goes up to the siblings of its parent. Each leaf then takes whole epochs, each in a seeded order of its own, and of
the last epoch the longest prefix that fits. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough, stored

#: Share of the corpus's tokens that the mix has.
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2
SEED = 17
#: Documents of a leaf that one bucket of the seeded order holds, about; prefix sums run over buckets, then in one.
BUCKET_ROWS = 2048
#: Leaves up to which their table is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
LEVELS = ("domain", "language", "source")

#: Target weights of the nodes, by level: integers, 1 where nothing is said.
WEIGHTS = {"language": {"en": 4, "fr": 2, "de": 2, "es": 2}}


def domain_of(source: Column) -> Column:
    """The domain of a source where documents don't carry one: the last digit of its name, modulo 4."""
    digit = F.regexp_extract(source, r"(\d)$", 1)
    return F.when(digit == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (digit.try_cast("int") % 4).cast("string")))


def place(doc_id: Column, epoch: Column, seed: int = SEED) -> Column:
    """Seeded order of documents in an epoch: a whole number under 2 ** 52."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


def leaves(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> one narrow row for each: doc_id, the levels, tokens (words).

    A null text has no words; texts of any length are whole; null levels count as empty names. Other columns, whatever
    their names, are ignored; no rows give no rows.
    """
    words = F.coalesce(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")
    text = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("doc_id", domain_of(text[1]).alias("domain"), text[0].alias("language"), text[1].alias("source"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("tokens"))


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level) or {}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col(level)], F.lit(1)).cast("long") if known else F.lit(1).cast("long")


def _shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent..., given, room, weight) -> given becomes each node's own part of its parent's ``given``.

    Nodes fill up in the order of room by weight: those whose part at the level of the rest would exceed their room
    get their room, the others share what is left by weight.
    """
    ratio = F.coalesce(F.try_divide("room", "weight"), F.lit(float("inf")))  # a node of weight 0 gets nothing
    order = Window.partitionBy(*parent).orderBy(ratio, nodes.columns[len(parent)])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.coalesce(F.try_divide(F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0)), rest), F.lit(0.0))
    filled = nodes.withColumn("level", level).withColumn("full", ratio <= F.col("level"))
    # levels fall after the first node that doesn't fill up; its level holds for all that don't
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*parent))
    return filled.withColumn("given", F.when(F.col("full"), F.col("room").cast("double")).otherwise(open_level * F.col("weight"))).drop("level", "full")


def budgets(stats: DataFrame, budget: int, weights: dict, max_epochs: int) -> DataFrame:
    """stats(domain, language, source, docs, tokens), one row for each leaf -> with given: the tokens it may use."""
    room = stats.withColumn("room", F.col("tokens") * max_epochs)
    found = None
    for depth, level in enumerate(LEVELS):
        key, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = room.groupBy(*key).agg(F.sum("room").alias("room"))
        if found is None:
            nodes = nodes.withColumn("given", F.lit(float(budget)))
        else:
            nodes = nodes.join(found, parent)
        parent_columns = parent or ["top"]
        nodes = nodes.withColumn("weight", _weight(level, weights))
        nodes = nodes if parent else nodes.withColumn("top", F.lit(0))
        found = cut(_shared(nodes.select(*parent_columns, level, "given", "room", "weight"), parent_columns).select(*key, "given"))
    return stats.join(found, list(LEVELS))


def selection(narrow: DataFrame, budget_share: float = BUDGET_SHARE, weights: dict | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """narrow: what ``leaves`` gives -> (doc_id, domain, language, source, tokens, copies): the rows with copies > 0.

    copies is the number of epochs that take the document. Rows without tokens are never taken. Rows that repeat an
    id count apart and are ordered alike, so the last epoch takes all or none of them; documents at one place of the
    seeded order likewise. No rows, or no budget, give no rows.
    """
    weights = WEIGHTS if weights is None else weights
    key = list(LEVELS)
    usable = stored(narrow.where("tokens > 0"))  # texts are read once; what follows reads these narrow rows
    stats = cut(usable.groupBy(*key).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    total = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = budgets(stats, int(total * budget_share), weights, max_epochs)
    # whole epochs, then what is left for a prefix of one more; buckets of the seeded order by the number of documents
    plan = plan.withColumn("epochs", F.least(F.floor(F.col("given") / F.col("tokens")), F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("left", F.floor("given").cast("long") - F.col("epochs") * F.col("tokens"))
    plan = cut(plan.select(*key, "epochs", "left", F.ceil(F.col("docs") / BUCKET_ROWS).cast("long").alias("buckets")))
    side = F.broadcast(plan) if small_enough(plan, BROADCAST_ROWS) else plan
    at = usable.join(side, key).withColumn("place", place(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("epochs"), seed))
    at = at.withColumn("slot", F.floor(F.col("place") / F.lit(float(1 << 52)) * F.col("buckets")).cast("long"))
    sums = at.where("left > 0").groupBy(*key, "left", "slot").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # only the bucket in which the budget ends is looked at row by row
    last = cut(sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("held") > F.col("left"))).select(*key, F.col("slot").alias("last"), "before"))
    edge = at.join(F.broadcast(last) if small_enough(last, BROADCAST_ROWS) else last, key).where(F.col("slot") == F.col("last"))
    run = Window.partitionBy(*key).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(run)).where(F.col("upto") <= F.col("left"))
    ends = cut(fits.groupBy(*key).agg(F.max("place").alias("through")).join(last.select(*key, "last"), key, "right"))
    ends = F.broadcast(ends) if small_enough(ends, BROADCAST_ROWS) else ends
    taken = at.join(ends, key, "left")
    within = (F.col("left") > 0) & (F.col("last").isNull() | (F.col("slot") < F.col("last")) | (F.col("place") <= F.coalesce("through", F.lit(-1))))
    return taken.select("doc_id", *key, "tokens", (F.col("epochs") + within.cast("long")).alias("copies")).where("copies > 0")
