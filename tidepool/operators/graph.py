"""Concept graph: loading, sensing, walking, spreading and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import Walk
from tidepool.functions.text import SPACE, character_pairs
from tidepool.sources.shared import cut, drop


def adjacency(edges: DataFrame, default_relation: str = "关联") -> DataFrame:
    """(node, neighbour, relation, adj_ord): every edge from both of its ends, in the order of loading.

    Edges without an end, null or empty, are dropped; a null relation is the default one; a self loop
    appears twice, as it does in an adjacency list.
    """
    rows = edges.where("src <> '' AND dst <> ''").withColumn("relation", F.coalesce("relation", F.lit(default_relation)))
    there = rows.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "relation", (F.col("ord") * 2).alias("adj_ord"))
    back = rows.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "relation", (F.col("ord") * 2 + 1).alias("adj_ord"))
    return there.union(back)


def _keyed(df: DataFrame, phrase: str) -> DataFrame:
    """With the phrase's first two characters as ``key``, by which texts that may hold it are found."""
    return df.withColumn("key", F.substring(phrase, 1, 2))


def sense(texts: DataFrame, nodes: DataFrame, p: Walk = Walk()) -> DataFrame:
    """(qid, rank, node, title, score): the nodes a text (qid, text) touches, the best few.

    A node scores ``whole_title`` if its title, in lower case, occurs in the text, else ``title_word``
    if a word of it, longer than one character, does; ties go in the nodes' order. Titles and words are
    found by an equality join of the pairs of characters of a text with the phrases that begin so, so
    texts do not meet all nodes; of the nodes that share a title or word only the first few in order
    are carried, since no later one can be among the best.

    Null texts and titles: a null text touches nothing, a node without a title is known by its id.
    """
    named = nodes.select(F.col("id").alias("node"), F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("title"), "ord").withColumn("low", F.lower("title"))
    first = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("ord", "node"))).where(F.col("k") <= p.hits).drop("k")
    whole = first(named.select(F.col("low").alias("phrase"), "node", "title", "ord"), "phrase").withColumn("score", F.lit(p.whole_title))
    split = named.select(F.explode(F.array_distinct(F.split("low", f"[{SPACE}]+"))).alias("phrase"), "node", "title", "ord").where(F.length("phrase") > 1)
    word = first(split, "phrase").withColumn("score", F.lit(p.title_word))
    phrases = whole.union(word)
    low = texts.where("text IS NOT NULL").select("qid", F.lower("text").alias("text"))
    grams = F.concat(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), character_pairs(F.col("text")))
    keys = low.select("qid", F.explode(F.array_distinct(grams)).alias("key"))
    vocabulary = _keyed(phrases.select("phrase").distinct(), "phrase")
    met = keys.join(vocabulary, "key").join(low, "qid").where(F.contains("text", "phrase")).select("qid", "phrase")
    hits = met.join(phrases, "phrase").groupBy("qid", "node").agg(F.max("score").alias("score"), F.first("title").alias("title"), F.first("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord", "node"))
    return hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= p.hits).select("qid", "rank", "node", "title", "score")


def walk(seeds: DataFrame, adjacent: DataFrame, p: Walk = Walk()) -> DataFrame:
    """(qid, place, node, relation, depth): nodes found from seeds (qid, rank, node), in breadth-first order.

    Level by level: a neighbour not met before is given to the first parent, then the first edge, that
    reaches it. The limit of nodes is looked at before a parent is expanded, not while it is, so a
    wide parent may exceed it. Edges of a level are joined by node; parents are cut to those that
    would be expanded before their neighbours are.
    """
    adjacent, adjacent_path = cut(adjacent, "adjacent")
    start = seeds.groupBy("qid", "node").agg(F.min("rank").alias("rank"))
    met = start.select("qid", "node")
    parents = start.select("qid", "node", F.col("rank").alias("place"))
    found, done, paths = None, None, []
    for depth in range(1, p.depth + 1):
        reached = parents.join(adjacent, "node").select("qid", F.col("place").alias("parent"), "adj_ord", F.col("neighbour").alias("node"), "relation")
        new = reached.join(met, ["qid", "node"], "left_anti")
        new = new.groupBy("qid", "node").agg(F.min(F.struct("parent", "adj_ord", "relation")).alias("f")).select("qid", "node", "f.parent", "f.adj_ord", "f.relation")
        # nodes found before each parent is taken from the queue
        counts = new.groupBy("qid", "parent").agg(F.count("*").alias("n"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("earlier", earlier)
        if done is not None:
            counts = counts.join(done, "qid", "left").withColumn("earlier", F.col("earlier") + F.coalesce("before", F.lit(0))).drop("before")
        open_ = counts.where(F.col("earlier") < p.nodes).select("qid", "parent", "earlier")
        new = new.join(open_, ["qid", "parent"])
        place = F.col("earlier") + F.row_number().over(Window.partitionBy("qid", "parent").orderBy("adj_ord"))
        level, path = cut(new.select("qid", place.cast("bigint").alias("place"), "node", "relation", F.lit(depth).cast("bigint").alias("depth")), "level")
        paths.append(path)
        found = level if found is None else found.union(level)
        done = found.groupBy("qid").agg(F.count("*").alias("before"))
        met = met.union(level.select("qid", "node"))
        parents = level.select("qid", "node", "place")
    out, _ = cut(found, "walk")
    drop(seeds.sparkSession, adjacent_path, *paths)
    return out


def spread(seeds: DataFrame, adjacent: DataFrame, depth: int = 2, keep: float = 0.5) -> DataFrame:
    """(qid, node, strength): activation of seeds (qid, node, strength) spread over edges (own design).

    At each step a node passes ``keep`` of its strength, shared by its edges, to its neighbours;
    strengths of a node add up over steps. Sums are combined before each shuffle.
    """
    degree = adjacent.groupBy("node").agg(F.count("*").alias("degree"))
    shared = adjacent.join(degree, "node").groupBy("node", "neighbour").agg((F.count("*") / F.first("degree")).alias("share"))
    shared, path = cut(shared, "shares")
    now = seeds.select("qid", "node", F.col("strength").cast("double").alias("strength"))
    total = now
    for _ in range(depth):
        now = now.join(shared, "node").groupBy("qid", F.col("neighbour").alias("node")).agg(F.sum(F.col("strength") * F.col("share") * keep).alias("strength"))
        total = total.union(now)
    out, _ = cut(total.groupBy("qid", "node").agg(F.sum("strength").alias("strength")), "spread")
    drop(seeds.sparkSession, path)
    return out


def cooccurrence(items: DataFrame, group: str, item: str, least: int = 2, most_groups: int | None = None) -> DataFrame:
    """(a, b, n): items that occur together in at least ``least`` groups, a < b (own design).

    Groups are small sets of items, such as the labels of a record; a repeated item counts once.
    """
    sets = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    # equal sets are counted once with their number, so a hot set makes its pairs once
    sets = sets.groupBy("s").agg(F.count("*").alias("times")).where(F.size("s") > 1)
    pairs = sets.select("times", F.posexplode("s").alias("i", "a"), "s").select("times", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("n")).where(F.col("n") >= least)


def partition(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, part, is_centre): parts of the graph by connection, and the best connected node of each (own design).

    Every node takes the smallest name among its own and its neighbours' parts, and then that part's
    own part, until nothing changes; where that takes more than ``most_rounds``, if given, it is an error. Of a part the node with the most edges is its centre, ties by name.
    """
    links = adjacency(edges).select("node", "neighbour").distinct()
    links, links_path = cut(links, "links")
    parts, path = cut(links.groupBy("node").agg(F.least(F.min("neighbour"), F.col("node")).alias("part")), "parts")
    rounds = 0
    while True:
        near = links.join(parts.select(F.col("node").alias("neighbour"), "part"), "neighbour").groupBy("node").agg(F.min("part").alias("near"))
        moved = parts.join(near, "node").select("node", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        up = moved.select(F.col("node").alias("part"), F.col("part").alias("above"))
        new = moved.join(up, "part").select("node", "old", F.least("part", "above").alias("part"))
        new, next_path = cut(new, "parts")
        still = new.where("part <> old").isEmpty()
        drop(edges.sparkSession, path)
        parts, path = new.select("node", "part"), next_path
        if still:
            break
        rounds += 1
        if rounds == most_rounds:
            raise RuntimeError(f"parts still change after {most_rounds} rounds")
    degree = links.groupBy("node").agg(F.count("*").alias("degree"))
    centre = parts.join(degree, "node").groupBy("part").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("c")).select("part", F.col("c.node").alias("centre"))
    out, _ = cut(parts.join(centre, "part").select("node", "part", (F.col("node") == F.col("centre")).alias("is_centre")), "partition")
    drop(edges.sparkSession, links_path, path)
    return out
