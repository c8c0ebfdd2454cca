"""Mixing sources to target weights: Efraimidis-Spirakis sampling within token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.encode import TOKENIZERS, load_ranks, token_counter
from tidepool.sources.shared import cut, drop

#: Buckets of the sampling key of each source, for prefix sums without sorting a source in one task.
BUCKETS = 4096
#: Most rows of a table of targets that is sent to all executors; a longer one is joined by shuffles.
SENT_TARGETS = 10_000


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, quality) of each document; null and empty texts have no tokens.

    Quality, over 0 and at most 1, is the share of letters and digits times the variety of
    characters, so that runs of marks or of one character are drawn late.
    """

    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(ranks.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            quality = np.array([_quality(x) for x in texts], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count(texts), pa.int64()), pa.array(quality)], names=["doc_id", "source", "n_tokens", "quality"])

    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, quality double")


def _quality(text: str | None) -> float:
    if not text:
        return 0.05
    solid = sum(map(str.isalnum, text)) / len(text)
    variety = min(1.0, len(set(text)) / (2 * len(text) ** 0.5))
    return max(0.05, solid * variety)


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, size, share, budget, epochs, rest) of each target.

    ``share`` is the target share among the sources that have tokens. The total, if not given, is
    the largest with which every such source can give its share within its repeats; of a larger
    total a source gives what its repeats allow.
    """
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("documents"))
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = wanted.join(held, "source", "left").fillna(0, ["size", "documents"])
    present = F.when(F.col("size") > 0, F.col("target_share"))
    whole = plan.agg(F.sum(present).alias("present"), F.min(F.col("max_repeats") * F.col("size") / present).alias("ratio"))
    plan = plan.crossJoin(whole).withColumn("share", F.when(F.col("size") > 0, F.col("target_share") / F.col("present")).otherwise(0.0))
    all_tokens = F.col("ratio") * F.col("present") if total is None else F.lit(float(total))
    plan = plan.withColumn("budget", F.least(all_tokens * F.col("share"), (F.col("max_repeats") * F.col("size")).cast("double")))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size") + 1e-9)).otherwise(0)
    plan = plan.withColumn("epochs", F.least(epochs, F.col("max_repeats")).cast("int"))
    rest = F.greatest(F.col("budget") - F.col("epochs") * F.col("size"), F.lit(0.0))
    return plan.withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), 0.0).otherwise(rest)).drop("present", "ratio")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, n_tokens, times) and the report of shares.

    A source's budget is filled by complete epochs over its documents and then by a weighted sample
    without replacement: each document has the key E / quality with E exponential, from a hash of
    its id and the seed, and the documents with the smallest keys are taken while half of the
    document still fits, so a source misses its budget by half a document at most.

    Prefix sums over a source need no sort of the source: keys fall into BUCKETS buckets in their
    order, the buckets' tokens are summed (combined before the shuffle), the bucket in which the
    budget ends is found, and only its documents are sorted. A source may hold any part of the rows.

    The report has (source, target_share, share, documents, size, selected_tokens, reached_share,
    most_repeats). A target without documents has the reached share 0 and the others keep their
    proportions; sources without target, null sources and documents without tokens are not
    selected; repeated rows are documents of their own; empty tables give empty results.
    """
    sizes, sizes_path = cut(sized(documents, folder=folder), "sizes")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = sizes.where("n_tokens > 0").withColumn("rank_key", -F.log(unit) / F.col("quality"))
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("rank_key") / 4)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    plan, plan_path = cut(budgets(sizes, targets, total), "budgets")
    small = targets.limit(SENT_TARGETS + 1).count() <= SENT_TARGETS
    send = F.broadcast if small else (lambda df: df)

    filled = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")).join(send(plan.select("source", "rest")), "source")
    # sums over at most BUCKETS rows of each source
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    edges = filled.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min_by("bucket", "upto").alias("edge"), F.min(F.col("upto") - F.col("tokens")).alias("below"))
    ends = send(plan.join(edges, "source", "left").select("source", "epochs", "rest", "edge", F.coalesce("below", F.lit(0)).alias("below")))
    rows = keyed.join(ends, "source")
    sure = rows.where("edge IS NULL OR bucket <> edge").withColumn("extra", F.when(F.col("rest") <= 0, 0).when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("rank_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("below") + F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.col("rest")
    last = rows.where("bucket = edge").withColumn("extra", F.when((F.col("rest") > 0) & fits, 1).otherwise(0))
    chosen = sure.unionByName(last).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("times")).where("times > 0")
    chosen, _ = cut(chosen, "mixture")
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("selected_tokens"), F.max("times").alias("most_repeats"))
    report = plan.join(reached, "source", "left").fillna(0, ["selected_tokens", "most_repeats"])
    total_tokens = report.agg(F.sum("selected_tokens").alias("all_tokens"))
    report = report.crossJoin(total_tokens).select(
        "source", "target_share", "share", "documents", "size", "selected_tokens", F.coalesce(F.try_divide(F.col("selected_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0)).alias("reached_share"), "most_repeats"
    )
    report, _ = cut(report, "shares")
    drop(documents.sparkSession, sizes_path, plan_path)
    return chosen, report
