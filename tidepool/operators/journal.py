"""Event journals: decisions of runs, shadow reports, effect ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import DROPPED_TOOLS

SCHEMA = "run_id string, kind string, task string, vision struct<visible: array<string>>, tool string, match boolean"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Journal rows of lines of JSON, with ``pos`` if given; blank lines and bad JSON are skipped."""
    rows = lines.withColumn("r", F.from_json(column, SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    keep = [c for c in lines.columns if c != column]
    return rows.where("r IS NOT NULL AND r._bad IS NULL").select(*keep, "r.run_id", "r.kind", "r.task", "r.vision", "r.tool", "r.match")


def decisions(journal: DataFrame, dropped: tuple[str, ...] = DROPPED_TOOLS) -> DataFrame:
    """(run_id, context, names, gold): of each run the task of its last start and its first real tool.

    Rows have ``pos``, their place in the journal. Runs without a task, a tool or visible names, or
    whose tool is not visible, are left out. A run is aggregated, never collected.
    """
    start = F.col("kind") == "task_start"
    tool = (F.col("kind") == "round") & (F.coalesce("tool", F.lit("")) != "") & ~F.col("tool").isin(*dropped)
    runs = journal.where("run_id <> ''").groupBy("run_id").agg(
        F.max_by(F.when(start, F.coalesce("task", F.lit(""))), F.when(start, F.col("pos"))).alias("context"),
        F.max_by(F.when(start, F.coalesce(F.col("vision.visible"), F.array().cast("array<string>"))), F.when(start, F.col("pos"))).alias("names"),
        F.min_by("tool", F.when(tool, F.col("pos"))).alias("gold"),
    )
    return runs.where((F.col("context") != "") & F.array_contains("names", F.col("gold"))).select("run_id", "context", "names", "gold")


def shadow_report(journal: DataFrame, suggestion: str = "shadow", outcome: str = "shadow_result", last: int | None = None) -> DataFrame:
    """(suggestions, results, matched, rate) by the ends of the rows' kinds; the rate is null without results.

    With ``last`` only the latest so many suggestions and the latest so many results, by ``pos``, count.
    """
    if last is not None:
        latest = lambda end: journal.where(F.col("kind").endswith(end)).orderBy(F.desc("pos")).limit(last)
        journal = latest(suggestion).union(latest(outcome))
    result = F.coalesce(F.col("kind").endswith(outcome), F.lit(False))
    out = journal.agg(F.count_if(F.col("kind").endswith(suggestion)).alias("suggestions"), F.count_if(result).alias("results"), F.count_if(result & F.coalesce("match", F.lit(False))).alias("matched"))
    return out.withColumn("rate", F.try_divide(F.col("matched").cast("double"), F.col("results")))


# Words by which a user confirms or corrects what was recalled (own choice).
CONFIRMED, CORRECTED = ("对的", "没错", "正确", "thanks", "confirmed"), ("不对", "错了", "不是这样", "wrong", "corrected")


def effects(turns: DataFrame) -> DataFrame:
    """(owner, cited, confirmed, corrected, score) of turns (owner, injected, answer, next_user).

    What was injected is cited (+1) if the answer holds it; the next user text confirms (+2) or corrects
    (-2), correcting first. Settled once each, a turn late (own rule; only the weights are given).
    """
    from tidepool.functions.text import contains_any

    low = F.lower(F.coalesce("next_user", F.lit("")))
    corrected = contains_any(low, CORRECTED)
    confirmed = contains_any(low, CONFIRMED) & ~corrected
    cited = F.coalesce(F.contains(F.lower("answer"), F.lower("injected")) & (F.col("injected") != ""), F.lit(False))
    out = turns.groupBy("owner").agg(F.count_if(cited).alias("cited"), F.count_if(confirmed).alias("confirmed"), F.count_if(corrected).alias("corrected"))
    return out.withColumn("score", F.col("cited") + 2 * F.col("confirmed") - 2 * F.col("corrected"))
