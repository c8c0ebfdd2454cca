"""Evaluation of selectors: hits, log loss, calibration, baselines and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import Selector


def decided(rows: DataFrame, predicted: DataFrame, options: DataFrame) -> DataFrame:
    """(qid, label, oid, choice, ok, p_gold, confidence, margin) of the rows whose label is an option."""
    known = rows.select("qid", "label").join(F.broadcast(options.select(F.col("name").alias("label"), "oid")), "label")
    both = known.join(predicted, "qid")
    own = F.get(F.filter("ranking", lambda x: x["oid"] == F.col("oid")), F.lit(0))["p"]
    p_gold = F.coalesce(own, F.exp(-F.col("top")) / F.col("z"))
    return both.select("qid", "label", "oid", "choice", (F.col("choice") == F.col("oid")).alias("ok"), p_gold.alias("p_gold"), "confidence", "margin")


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(ece): mean gap of confidence and hits over equal bins; a confidence of 1 is in the last bin."""
    place = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins))
    by_bin = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("ok").cast("double")).alias("a"))
    total = by_bin.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))).alias("gap"))
    return total.select(F.coalesce(F.try_divide("gap", "n"), F.lit(0.0)).alias("ece"))


def metrics(rows: DataFrame) -> DataFrame:
    """(n, hits, top1, logloss, ece) in one row; zeros without rows."""
    loss = -F.log(F.greatest("p_gold", F.lit(1e-12)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    main = rows.agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"), zero(F.avg(F.col("ok").cast("double"))).alias("top1"), zero(F.avg(loss)).alias("logloss"))
    return main.crossJoin(calibration_error(rows))


def per_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"), F.avg(F.col("ok").cast("double")).alias("accuracy"))


def baselines(train: DataFrame, test: DataFrame, picks: DataFrame, bm25_ok: DataFrame, n_options: DataFrame) -> DataFrame:
    """(n, majority, majority_top1, rule_top1, bm25_top1, random_top1); the majority's ties go to the first seen."""
    most = train.groupBy("label").agg(F.count("*").alias("k"), (-F.min("qid")).alias("seen"))
    majority = most.agg(F.max_by("label", F.struct("k", "seen")).alias("majority"))
    rows = test.select("qid", "label").join(picks.select("qid", "name"), "qid").join(bm25_ok.select("qid", "ok"), "qid").crossJoin(F.broadcast(majority)).crossJoin(F.broadcast(n_options))
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(
        F.count("*").alias("n"), F.first("majority").alias("majority"), share(F.col("label") == F.col("majority")).alias("majority_top1"),
        share(F.col("label") == F.col("name")).alias("rule_top1"), share(F.col("ok")).alias("bm25_top1"), F.avg(1.0 / F.col("n_options")).alias("random_top1"),
    )


def gate_sweep(rows: DataFrame, picks: DataFrame, p: Selector = Selector()) -> DataFrame:
    """(threshold, injected, coverage, hint_top1, harm, gain) at each confidence threshold; null rates without a hint."""
    both = rows.join(picks.select("qid", "name"), "qid")
    each = both.withColumn("threshold", F.explode(F.array(*map(F.lit, p.sweep))))
    on = (F.round("confidence", 4) >= F.col("threshold")) & (F.round("margin", 4) >= p.least_margin)
    out = each.groupBy("threshold").agg(
        F.count_if(on).alias("injected"), F.count("*").alias("n"), F.count_if(on & F.col("ok")).alias("hit"), F.avg((F.col("label") == F.col("name")).cast("double")).alias("rule")
    )
    top1 = F.try_divide(F.col("hit").cast("double"), F.col("injected"))
    return out.select("threshold", "injected", F.round(F.col("injected") / F.col("n"), 4).alias("coverage"), F.round(top1, 4).alias("hint_top1"), (F.col("injected") - F.col("hit")).alias("harm"), F.round(top1 - F.col("rule"), 4).alias("gain"))


def by_opinion(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """(opinion, n, selector_top1, rule_top1) of the rows with and without an opinion of the rule."""
    both = rows.join(picks, "qid")
    return both.groupBy("opinion").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("selector_top1"), F.avg((F.col("label") == F.col("name")).cast("double")).alias("rule_top1"))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def latency(rows: DataFrame, value: str) -> DataFrame:
    """(n, mean, median, largest, p95): p95 is the value at place max(0, int(0.95 n) - 1) of the sorted ones."""
    known = rows.where(F.col(value).isNotNull())
    n = known.agg(F.count("*").alias("n")).first().n
    place = max(0, int(n * 0.95) - 1)
    share = place / (n - 1) if n > 1 else 0.0
    return known.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("largest"), F.percentile(value, share).alias("p95"))


def report(rows: DataFrame, predicted: DataFrame, options: DataFrame, picks: DataFrame, p: Selector = Selector()) -> dict:
    """All figures of a selector on labelled rows, for display: a handful of rows are fetched."""
    done = decided(rows, predicted, options)
    known = done.select("qid", "label")
    first = lambda df: df.first().asDict()
    return {
        "metrics": first(metrics(done)),
        "baselines": first(baselines(known, known, picks, done, options.agg(F.count("*").alias("n_options")))),
        "subsets": [r.asDict() for r in by_opinion(done, picks).collect()],
        "sweep": [r.asDict() for r in gate_sweep(done, picks, p).orderBy("threshold").collect()],
        "labels": [r.asDict() for r in label_counts(rows, "label").orderBy(F.desc("n"), "label").limit(100).collect()],
    }
