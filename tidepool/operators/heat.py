"""Heat dynamics: decay, pulses and observation of the heat of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import PROTECTED_MARKERS, Heat
from tidepool.functions.text import clock, contains_any, seconds_between


def protected(layer: Column, tags: Column, markers: tuple[str, ...] = PROTECTED_MARKERS) -> Column:
    """Whether a memory never cools below the floor: core layer or a protecting tag; null is neither."""
    return F.coalesce(layer == "core", F.lit(False)) | contains_any(tags, markers)


def decay(memories: DataFrame, as_of: str, p: Heat = Heat()) -> DataFrame:
    """(id, heat, new_heat, protected, changed, cold) of every memory with heat, at a given time.

    One projection over the scan: heat falls exponentially with the days since the last spark, slower
    for the protected, whose heat is raised to the floor. A missing or unreadable time counts as
    ``unknown_days``, a future one as no days. Rows without heat, null or not positive, are left out.
    """
    hot = memories.where("heat > 0").select("id", "heat", clock(F.col("last_sparked_at")).alias("at"), protected(F.col("layer"), F.col("tags")).alias("protected"))
    seconds = seconds_between(F.col("at"), F.lit(as_of).cast("timestamp_ntz"))
    days = F.greatest(F.lit(0.0), F.coalesce(seconds / 86400.0, F.lit(p.unknown_days)))
    rate = F.when(F.col("protected"), p.protected_decay).otherwise(p.decay)
    cooled = F.col("heat") * F.exp(-rate * days)
    new = hot.withColumn("new_heat", F.when(F.col("protected"), F.greatest(cooled, F.lit(p.floor))).otherwise(cooled))
    changed = F.abs(F.col("new_heat") - F.col("heat")) > p.least_change
    return new.select("id", "heat", "new_heat", "protected", changed.alias("changed"), (~F.col("protected") & (F.col("new_heat") < p.cold)).alias("cold"))


def decay_summary(decayed: DataFrame) -> DataFrame:
    """How many memories changed, are protected and are cold, of the rows of decay()."""
    return decayed.agg(*(F.count_if(x).alias(x) for x in ("changed", "protected", "cold")))


def pulse(memories: DataFrame, hits: Column, p: Heat = Heat()) -> DataFrame:
    """(id, new_heat) after so many sparks; null heat or hits count as 0."""
    heat = F.coalesce("heat", F.lit(0.0)) + p.spark * F.coalesce(hits, F.lit(0))
    return memories.select("id", F.least(heat, F.lit(p.cap)).alias("new_heat"))


def histogram(memories: DataFrame, p: Heat = Heat()) -> DataFrame:
    """Per owner: rows, hot, protected, sunk, and the four bands of heat; a null owner is one owner."""
    heat, safe = F.coalesce("heat", F.lit(0.0)), protected(F.col("layer"), F.col("tags"))
    counts = {
        "hot": heat > 0,
        "protected": safe,
        "sunk": (heat > 0) & (heat < p.cold) & ~safe,
        "over_2": heat > 2,
        "over_1": (heat > 1) & (heat <= 2),
        "over_half": (heat >= 0.5) & (heat <= 1),
        "under_half": (heat > 0) & (heat < 0.5),
    }
    return memories.groupBy("owner").agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in counts.items()))
