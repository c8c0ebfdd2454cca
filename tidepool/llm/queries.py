"""Queries of the problems: pN_..., each over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import alike, copies, distinctive, encode, forest, mixing, neardup, subjects
from tidepool.llm.sketch import MIN_CORE
from tidepool.sources.shared import drop, new_path

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms at least three times in a record and in two to six records of the table."""
    rows = distinctive.memories_and_tools(_read(spark, folder, "memories"), _read(spark, folder, "tools"), least_tf=3, most_df=6)
    return rows.where("score IS NOT NULL").select("src", "rec_key", "term")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.memories_and_tools(_read(spark, folder, "memories"), _read(spark, folder, "tools")).withColumn("score", F.round("score", 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, folder, "memories"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_read(spark, folder, "memories"))


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(_read(spark, folder, "memories")).select("id", "copies")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    state = new_path(spark, "forest")
    found = forest.repeated_memories(_read(spark, folder, "memories"), _read(spark, folder, "memory_batches"), state)
    drop(spark, state)
    return found


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike.alike_pairs(("memories", _read(spark, folder, "memories"), "id", "content", MIN_CORE), ("gold", _read(spark, folder, "gold"), "gold_id", "context"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    forms = [
        _read(spark, folder, table).select(F.lit(table).alias("src"), F.col(key).alias("id"), alike.consistent(text).alias("form"))
        for table, key, text in (("memories", "id", "content"), ("gold", "gold_id", "context"))
    ]
    return forms[0].union(forms[1])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encoded(_read(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, decoded from its ids."""
    return encode.decoded(encode.encoded(_read(spark, folder, "documents")))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[1]


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects(_read(spark, folder, "documents"), _read(spark, folder, "area_labels"), _read(spark, folder, "subject_areas"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "area")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(_subjects(spark, folder))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p3_found, p3_collapsed, p4_found, p5_found, p5_forms, p7_ids, p7_round_trip, p8_mixture, p8_shares, p9_found, p9_composition)}
