"""Sources and sinks: memory tables, JSON stores, graph indexes, gold rows, catalogues, models, journals."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool import schema
from tidepool.operators import journal
from tidepool.operators.records import numbered


@dataclass(frozen=True)
class Places:
    """Where a store's tables and files are, by parameter or environment."""

    memories: str = ""
    graph: str = ""
    use_json: bool = False

    @classmethod
    def from_environment(cls) -> Places:
        get = os.environ.get
        return cls(get("TIDEPOOL_MEMORIES", ""), get("TIDEPOOL_GRAPH", ""), get("TIDEPOOL_USE_JSON") == "1")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], kind)


def memory_table(spark: SparkSession, path: str) -> DataFrame:
    """The memories at a path, with the columns of the fixed schema and the optional ones; empty if there are none."""
    rows = spark.read.parquet(path) if exists(spark, path) else _empty(spark, schema.MEMORIES)
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in schema.OPTIONAL.items() if c not in have})


def append_memories(rows: DataFrame, path: str) -> None:
    """Append rows to the memory table; what is there is never changed or deleted."""
    rows.write.mode("append").parquet(path)


def ledger_path(path: str) -> str:
    return path.rstrip("/") + "_ledger"


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append entries (id, seq, at, and status or heat) to the ledger beside a memory table."""
    kinds = dict(x.split() for x in schema.LEDGER.split(", "))
    full = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
    full.write.mode("append").parquet(ledger_path(path))


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """memory_table() as it is by now: the latest status and the latest heat of each memory that the ledger has of it."""
    rows = memory_table(spark, path)
    if not exists(spark, ledger_path(path)):
        return rows
    ledger = spark.read.schema(schema.LEDGER).parquet(ledger_path(path))
    when = lambda c: F.when(F.col(c).isNotNull(), F.struct("at", "seq"))
    now = ledger.groupBy("id").agg(*(F.max_by(c, when(c)).alias(f"_{c}") for c in ("status", "heat")))
    both = rows.join(now, "id", "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("status", "heat") else F.col(c) for c in rows.columns))


# -- JSON store: {entries: [{id, time, tag, content}], next_id, meta} -------------------------------

# Keys of a graph index, in either language.
NODE_LISTS, EDGE_LISTS, TYPES = ("节点", "nodes"), ("丝线", "edges"), ("类型", "type")
SOURCES, TARGETS, RELATIONS = ("源", "source", "from"), ("目标", "target", "to"), ("关系", "relation")


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, tags, content, pos) of a JSON store in the order of its entries; empty if there is none."""
    entry = "struct<id: bigint, `时间`: string, `标签`: string, `内容`: string>"
    if not exists(spark, path):
        return _empty(spark, "id bigint, ts string, tags string, content string, pos bigint")
    store = spark.read.schema(f"`条目列表` array<{entry}>").json(path, multiLine=True)
    rows = store.select(F.posexplode("条目列表").alias("pos", "e"))
    return rows.select("e.id", F.col("e.`时间`").alias("ts"), F.col("e.`标签`").alias("tags"), F.col("e.`内容`").alias("content"), F.col("pos").cast("bigint").alias("pos"))


def last_entries(store: DataFrame, n: int) -> DataFrame:
    """The last n entries of a JSON store, oldest first."""
    return store.orderBy(F.desc("pos")).limit(n).orderBy("pos")


def write_json_store(rows: DataFrame, path: str, updated: str) -> None:
    """Write entries (id, ts, tags, content) as one JSON store, over what is there.

    The format is one document in one file; entries are put together in one task, as the format asks.
    For stores of any size use append_memories().
    """
    entry = F.struct("id", F.col("ts").alias("时间"), F.col("tags").alias("标签"), F.col("content").alias("内容"))
    whole = rows.agg(F.array_sort(F.collect_list(entry)).alias("条目列表"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"), F.struct(F.lit(updated).alias("最后更新"), F.count("*").alias("记录条数")).alias("元信息"))
    whole.coalesce(1).write.mode("overwrite").json(path)


def active_or_json(table: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of the table, or of the JSON store if the table has none."""
    return store.select("id", "ts", "tags", "content") if table.isEmpty() else table.select("id", "ts", "tags", "content")


# -- graph index ----------------------------------------------------------------------------------

def read_graph(spark: SparkSession, path: str, default_relation: str = "关联") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON graph index, whose nodes are a map or a list and whose keys are Chinese or English.

    Edges without an end are dropped; without a relation they have the default one.
    """
    if not exists(spark, path):
        return _empty(spark, schema.NODES), _empty(spark, schema.EDGES)
    whole = spark.read.text(path, wholetext=True)
    part = lambda c, names: F.coalesce(*(F.get_json_object(c, f"$.{n}") for n in names))
    raw = whole.select(part("value", NODE_LISTS).alias("nodes"), part("value", EDGE_LISTS).alias("edges"))
    is_list = F.col("nodes").startswith("[")
    listed = raw.where(is_list).select(F.posexplode(F.from_json("nodes", "array<string>")).alias("ord", "n"))
    listed = listed.select(F.coalesce(F.get_json_object("n", "$.id"), F.get_json_object("n", "$.title"), F.lit("")).alias("id"), "ord", "n")
    mapped = raw.where(~is_list).select(F.posexplode(F.map_entries(F.from_json("nodes", "map<string,string>"))).alias("ord", "e")).select(F.col("e.key").alias("id"), "ord", F.col("e.value").alias("n"))
    both = listed.union(mapped)
    nodes = both.select("id", F.get_json_object("n", "$.title").alias("title"), part("n", TYPES).alias("type"), F.col("ord").cast("bigint").alias("ord"))
    links = raw.select(F.posexplode(F.from_json("edges", "array<string>")).alias("ord", "e"))
    edges = links.select(part("e", SOURCES).alias("src"), part("e", TARGETS).alias("dst"), F.coalesce(part("e", RELATIONS), F.lit(default_relation)).alias("relation"), F.col("ord").cast("bigint").alias("ord"))
    return nodes, edges.where("src <> '' AND dst <> ''")


# -- selector files -------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the lines of a text file, pos in their order; the file is split like any other.

    pos is where a line's split begins plus its number in the task, which is below the next split's begin.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"))
    return lines.select((F.col("_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("pos"), "value")


def read_gold(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(qid, context, label) of lines of JSON, qid by place; blank lines are skipped, unknown labels if names are given."""
    lines = read_lines(spark, path).where(F.trim("value") != "").withColumn("_all", F.lit(1))
    rows = numbered(lines, "_all", "pos", "place").select((F.col("place") - 1).alias("qid"), F.from_json("value", schema.GOLD).alias("r"))
    rows = rows.select("qid", "r.context", "r.label")
    return rows if names is None else rows.join(F.broadcast(names.select(F.col("name").alias("label")).distinct()), "label", "left_semi").select("qid", "context", "label")


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """(oid, name, text) of a catalogue file, in its order; text is name and description, trimmed."""
    tools = spark.read.schema(schema.TOOLS).json(path, multiLine=True).select(F.posexplode("tools").alias("oid", "t"))
    return tools.select(F.col("oid").cast("bigint").alias("oid"), "t.name", F.trim(F.concat_ws(" ", "t.name", F.coalesce("t.description", F.lit("")))).alias("text"))


def distinct_options(options: DataFrame) -> DataFrame:
    """(text, oid) of the distinct option texts, in the order first seen."""
    return options.groupBy("text").agg(F.min("oid").alias("oid"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MODEL).json(path, multiLine=True)


def save_model(path: str, w: dict[str, float], b: float, meta: dict, idf: dict[str, float], avgdl: float, n: int, version: str = "v1") -> str:
    """Write a fitted selector as one small JSON document."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"w": w, "b": b, "meta": {k: str(v) for k, v in meta.items()}, "version": version, "lex": {"idf": idf, "avgdl": avgdl, "n": n}}, f, ensure_ascii=False)
    return path


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a journal of JSON lines with their place; bad lines are skipped, a missing file is empty."""
    if not exists(spark, path):
        return _empty(spark, "pos bigint, " + journal.SCHEMA)
    return journal.parse(read_lines(spark, path).where(F.trim("value") != ""))
