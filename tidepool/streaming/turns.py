"""Structured Streaming: hourly narratives with a watermark, and ingestion of turns through the gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.config import Write
from tidepool.functions.text import normalised
from tidepool.operators.gates import gate, layer_of, turn_tag, turn_text
from tidepool.sources.shared import new_path


def narrative_stream(events: DataFrame, ts: str, kind: str, late: str = "1 hour") -> DataFrame:
    """(hour, kind, n) of a stream: tumbling hours; events later than ``late`` are not counted."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", "1 hour").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """(hour, kind, n) of all events of a table, by one run of the stream over what is there."""
    table = spark.read.parquet(path)
    work = new_path(spark, "stream")
    # a path that is one file is read by its folder and name
    folder, name = path.rsplit("/", 1)
    plain = path.endswith(".parquet") and spark._jvm.java.io.File(path.removeprefix("file://")).isFile()
    reader = spark.readStream.schema(table.schema)
    source = reader.option("pathGlobFilter", name).parquet(folder) if plain else reader.parquet(path)
    rows = narrative_stream(source, "ts", "event_type", "3650 days")
    out = {}

    def keep(batch: DataFrame, number: int) -> None:
        target = f"{work}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        out[number] = target

    rows.writeStream.outputMode("complete").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out[max(out)]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "kind", "n")


def gated_turns(turns: DataFrame, p: Write = Write()) -> DataFrame:
    """Memories of a batch or stream of turns (owner, counter, user, assistant, at): gated, tagged, layered.

    Rows that a gate rejects are left out; nothing is looked up, so the plan is one projection.
    """
    text = turn_text(F.col("user"), F.col("assistant"), p)
    rows = turns.select("owner", "at", text.alias("content"), turn_tag(F.col("user"), F.col("counter")).alias("tag"), gate(text, p).alias("verdict")).where("verdict = 'pass'")
    return rows.select("owner", "content", F.to_json(F.array("tag")).alias("tags"), "at", layer_of(F.col("tag")).alias("layer"))


def ingest(turns: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a stream of turns through the gates; ``write`` gets each micro-batch and its number, so a
    batch that is written again after a failure replaces its former self."""
    stream = gated_turns(turns).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


STATE = T.StructType([T.StructField("seen", T.ArrayType(T.StringType()))])


def fresh_turns(memories: DataFrame, p: Write = Write()) -> DataFrame:
    """(owner, content, duplicate) of a stream: whether a text equals one of its owner's last ones, in order of arrival.

    The state of an owner is its last ``dedup_window`` normalised texts, so it stays bounded.
    """
    import pandas as pd

    window, shortest = p.dedup_window, p.least_dedup_length
    rows = memories.where("owner IS NOT NULL AND content IS NOT NULL").select("owner", "content", normalised(F.col("content")).alias("plain"))

    def run(key, frames, state):
        seen = list(state.get[0]) if state.exists else []
        for frame in frames:
            marks = []
            for plain in frame["plain"]:
                marks.append(len(plain) >= shortest and plain in seen)
                seen = [*seen, plain][-window:]
            yield pd.DataFrame({"owner": frame["owner"], "content": frame["content"], "duplicate": marks})
        state.update((seen,))

    return rows.groupBy("owner").applyInPandasWithState(run, "owner string, content string, duplicate boolean", STATE, "append", "NoTimeout")
