"""Reading, counting and numbering of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import tags_text

#: Rows of a group that are numbered in one task.
BLOCK = 50_000


def active(memories: DataFrame, owner: str) -> DataFrame:
    """(id, ts, tags, content) of an owner's active memories; tags as text, nulls as empty."""
    rows = memories.where((F.col("owner") == owner) & (F.col("status") == "active"))
    return rows.select("id", F.coalesce("ts", F.lit("")).alias("ts"), tags_text(F.col("tags")).alias("tags"), F.coalesce("content", F.lit("")).alias("content"))


def recent(memories: DataFrame, n: int = 30, only_active: bool = True, newest_first: bool = False) -> DataFrame:
    """(owner, rank, id, content) of the latest n memories of each owner; rank counts from 1.

    The latest are the largest ids. The limit is applied within each partition before the shuffle,
    so a hot owner sends n rows a task. Null owners are one owner.
    """
    rows = memories.where("status = 'active'") if only_active else memories
    latest = rows.select("owner", "id", "content").withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("id")))).where(F.col("k") <= n)
    order = F.col("k") if newest_first else F.count("*").over(Window.partitionBy("owner")) + 1 - F.col("k")
    return latest.select("owner", order.cast("bigint").alias("rank"), "id", "content")


def ledger(memories: DataFrame) -> DataFrame:
    """Counts of all, active, outdated, core and hot memories, in one pass."""
    counts = {"active": F.col("status") == "active", "outdated": F.col("status") == "outdated", "core": F.col("layer") == "core", "hot": F.col("heat") > 0}
    return memories.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def identity(core: DataFrame, importance: str, n: int = 3, cut: int = 60) -> DataFrame:
    """(rank, id, line) of the n most important rows, ties by id; lines are cut for display."""
    top = core.select("id", "content", F.col(importance).alias("importance")).orderBy(F.desc_nulls_last("importance"), "id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("importance"), "id"))
    return top.select(rank.cast("bigint").alias("rank"), "id", F.substring("content", 1, cut).alias("line"))


def weak_topics(conflicts: DataFrame, topic: str, weak_point: str, threshold: str) -> DataFrame:
    """Distinct topics whose weak point reaches its threshold; null comparisons do not."""
    return conflicts.where(F.col(weak_point) >= F.col(threshold)).select(F.col(topic).alias("topic")).distinct()


def previews(memories: DataFrame, cut: int = 30) -> DataFrame:
    """(id, preview, layer) with the first characters of each content."""
    return memories.select("id", F.substring("content", 1, cut).alias("preview"), "layer")


def first_known(*columns: Column) -> Column:
    """The first of several alternative columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def numbered(df: DataFrame, group: str, order: str, name: str = "seq") -> DataFrame:
    """df with the place, from 1, of each row in its group by an integer order column.

    Rows with a null group or order are left out. No group is sorted in one task: the order's range is
    cut into blocks of about BLOCK rows, blocks are counted, and a row's place is the count of the
    group's earlier blocks plus its place within its own.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(order).isNotNull())
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    width = max(1, (span.high - span.low) * BLOCK // max(1, span.n)) if span.n else 1
    rows = rows.withColumn("_block", F.floor((F.col(order) - F.lit(span.low or 0)) / F.lit(width)).cast("bigint"))
    sizes = rows.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(group, "_block", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    return rows.withColumn("_place", place).join(offsets, [group, "_block"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_block", "_place", "_before")
