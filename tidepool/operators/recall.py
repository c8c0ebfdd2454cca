"""Composite recall: channels, prefetch, system block, cover, compression and narratives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import Walk
from tidepool.functions.text import clock, seconds_between
from tidepool.operators.graph import sense, walk
from tidepool.operators.search import search
from tidepool.sources.shared import cut, drop

#: Channels of a recall, in the order they are shown.
CHANNELS = ("identity", "lit", "associated", "premonition", "weak")


#: Keywords of a text that are searched first; of those without enough results then eight times as many, and so on.
FIRST_KEYWORDS = 16


def channels(per: int = 3, **parts: DataFrame) -> DataFrame:
    """(channel, channel_rank, rank, id, line): the first rows of each channel, in the channels' fixed order.

    A channel is (rank, id, line). A channel that is not given is empty.
    """
    shown = []
    for place, name in enumerate(CHANNELS, 1):
        if name in parts:
            rows = parts[name].where(F.col("rank") <= per)
            shown.append(rows.select(F.lit(name).alias("channel"), F.lit(place).cast("bigint").alias("channel_rank"), F.col("rank").cast("bigint").alias("rank"), "id", "line"))
    return reduce(DataFrame.union, shown)


def prefetch(texts: DataFrame, memories: DataFrame, nodes: DataFrame, adjacent: DataFrame, owner: str, p: Walk = Walk()) -> DataFrame:
    """(qid, rank, id): memories that texts (qid, text) call to mind, at most a few each.

    Titles of the nodes a text touches and of those found from them are searched, in that order; results
    are taken keyword by keyword until there are enough, each once. A text that touches nothing is
    searched itself.
    """
    hits, hits_path = cut(sense(texts, nodes, p), "hits")
    near = walk(hits.select("qid", "rank", "node"), adjacent, p)
    titles = nodes.select(F.col("id").alias("node"), F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("title"))
    own = hits.select("qid", F.col("rank").alias("place"), "title")
    more = near.join(titles, "node", "left").select("qid", (F.col("place") + 1_000_000).alias("place"), F.coalesce("title", "node").alias("title"))
    direct = texts.join(hits.select("qid").distinct(), "qid", "left_anti").where("text <> ''")
    # titles give a few rows each; the text itself, where it touches nothing, as many as there are results
    asked = own.union(more).groupBy("qid", "title").agg(F.min("place").alias("place")).select("qid", "title", "place", F.lit(p.per_keyword).alias("most"))
    asked = asked.union(direct.select("qid", F.col("text").alias("title"), F.lit(0).cast("bigint").alias("place"), F.lit(p.results).alias("most")))
    turn = F.row_number().over(Window.partitionBy("qid").orderBy("place", "title"))
    asked, path = cut(asked.withColumn("turn", turn), "asked")
    longest = asked.agg(F.max("turn").alias("n")).first().n or 0
    done, paths, low, high = None, [path, hits_path], 0, FIRST_KEYWORDS
    while low < longest or done is None:
        # the next keywords of the texts that have not enough results so far
        now = asked.where((F.col("turn") > low) & (F.col("turn") <= high))
        if done is not None:
            full = done.groupBy("qid").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= p.results)
            now = now.join(full, "qid", "left_anti")
        found = search(memories, now.select(F.col("title").alias("keyword")).distinct(), owner, max(p.per_keyword, p.results))
        rows = now.join(found, now.title == found.keyword).where("rank <= most").select("qid", "place", "rank", "id")
        rows, rows_path = cut(rows if done is None else done.union(rows), "found")
        paths.append(rows_path)
        enough = rows.groupBy("qid").agg(F.count_distinct("id").alias("n")).where(F.col("n") >= p.results)
        done, low, high = rows, high, high * 8
        if low < longest and asked.where(F.col("turn") > low).join(enough, "qid", "left_anti").isEmpty():
            break
    each = done.groupBy("qid", "id").agg(F.min(F.struct("place", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("first", "id"))
    out, _ = cut(each.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= p.results).select("qid", "rank", "id"), "prefetch")
    drop(texts.sparkSession, *paths)
    return out


def first_channel(*parts: DataFrame) -> DataFrame:
    """(qid, channel, text): for each query the first of the channels (qid, text) that has an answer."""
    rows = reduce(DataFrame.union, [d.where("text <> ''").select("qid", F.lit(i).cast("bigint").alias("channel"), "text") for i, d in enumerate(parts, 1)])
    return rows.groupBy("qid").agg(F.min(F.struct("channel", "text")).alias("f")).select("qid", "f.channel", "f.text")


def cover(memories: DataFrame, budget: int = 20) -> DataFrame:
    """(id, age_rank): a budget of memories, dense near the end and ever sparser before (own design).

    The newest halves of the budget go to ages 1, 2, 3, ... and then to ages that grow by a constant
    factor to the oldest row, by id. Ages of the few chosen places are worked out, not stored: the
    places are found by exact ranks of the ids.
    """
    from tidepool.operators.records import numbered

    rows = numbered(memories.withColumn("_all", F.lit(1)), "_all", "id", "seq").select("id", "seq")
    n = rows.agg(F.max("seq").alias("n")).first().n or 0
    near = min(n, budget // 2)
    ages = set(range(1, near + 1))
    left = budget - near
    for i in range(1, left + 1):
        ages.add(min(n, max(1, round(near * (max(n, 1) / max(near, 1)) ** (i / max(left, 1))))))
    wanted = [n + 1 - a for a in sorted(ages) if 1 <= a <= n]
    return rows.where(F.col("seq").isin(wanted or [-1])).select("id", (F.lit(n) + 1 - F.col("seq")).cast("bigint").alias("age_rank"))


def compress(memories: DataFrame, as_of: str, days: int = 30, head: int = 40) -> DataFrame:
    """(id, compressed, skeleton): old memories as the head of their text, core ones whole (own design).

    Nothing is deleted: the result is a new column beside the unchanged content. An unreadable time is
    not old; null content stays null.
    """
    at = clock(F.replace(F.replace("created_at", F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" ")))
    old = F.coalesce(seconds_between(at, F.lit(as_of).cast("timestamp_ntz")) > days * 86400, F.lit(False))
    small = old & ~F.coalesce(F.col("layer") == "core", F.lit(False)) & (F.length("content") > head)
    small = F.coalesce(small, F.lit(False))
    return memories.select("id", small.alias("compressed"), F.when(small, F.concat(F.substring("content", 1, head), F.lit("…"))).otherwise(F.col("content")).alias("skeleton"))


def narratives(events: DataFrame, ts: str, group: Column, kind: str) -> DataFrame:
    """(grp, hour, n, kinds, first_kind): what happened in each hour of a group (own design)."""
    hour = F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz")
    rows = events.select(group.alias("grp"), hour.alias("hour"), F.col(ts).alias("ts"), F.col(kind).alias("kind"))
    return rows.groupBy("grp", "hour").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.min(F.struct("ts", "kind"))["kind"].alias("first_kind"))


def memory_list(channel: dict) -> list[dict]:
    """The memories in a channel's answer: a known key's list, else the first list of records with an id.

    Runs on the driver, on one answer.
    """
    if isinstance(channel, list):
        return channel
    known = ("lit", "related", "memories", "associated", "hits", "passages")
    for value in [*(channel.get(k) for k in known), *channel.values()] if isinstance(channel, dict) else []:
        if isinstance(value, list) and value and isinstance(value[0], dict) and "id" in value[0]:
            return value
    return []
