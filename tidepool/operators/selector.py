"""Lexical option selector: which option a context is about, with a probability and a gate.

Options are few (a catalogue); contexts are many. Contexts and options meet by an equality join on
tokens, so a pair without a common token, whose score is 0, is not made there: such options enter the
softmax by their number, and are filled in from the catalogue where all options are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import Selector
from tidepool.functions.text import token_bigrams, tokens


def option_texts(tools: DataFrame) -> DataFrame:
    """(oid, name, text) of a catalogue (name, description), oid from 0 by name; text is both, trimmed."""
    rows = tools.where("name IS NOT NULL").groupBy("name").agg(F.min(F.coalesce("description", F.lit(""))).alias("description"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("name", "description"))).alias("all"))
    return listed.select(F.posexplode("all").alias("oid", "o")).select(F.col("oid").cast("bigint").alias("oid"), "o.name", F.trim(F.concat_ws(" ", "o.name", "o.description")).alias("text"))


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(tokens(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))


def fit_lexical(documents: DataFrame, key: str = "oid", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(w, df, idf) of each token and (n, avgdl) of the documents; those without a token are skipped."""
    sized = documents.select(key, F.size(tokens(F.col(text))).alias("dl")).where("dl > 0")
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    counted = _terms(documents, key, text).groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.crossJoin(F.broadcast(stats)).select("w", "df", idf.alias("idf")), stats


def token_weights(options: DataFrame, idf: DataFrame, stats: DataFrame, p: Selector = Selector()) -> DataFrame:
    """(w, oid, part): what a shared token adds to an option's BM25; unknown tokens add 0."""
    sizes = options.select("oid", F.size(tokens(F.col("text"))).alias("dl"))
    rows = _terms(options, "oid", "text").join(sizes, "oid").join(idf.select("w", "idf"), "w", "left").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.coalesce("idf", F.lit(0.0)) * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avgdl")))
    return rows.select("w", "oid", part.alias("part"))


def bm25_scores(contexts: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, oid, shared, bm25) of the pairs with a common token; a context's tokens are a set."""
    asked = contexts.select("qid", F.explode(F.array_distinct(tokens(F.col("context")))).alias("w"))
    return asked.join(weights, "w").groupBy("qid", "oid").agg(F.count("*").alias("shared"), F.sum("part").alias("bm25"))


def features(contexts: DataFrame, options: DataFrame, scores: DataFrame, p: Selector = Selector()) -> DataFrame:
    """(qid, oid, shared, ov, ratio, shared_bigrams, bm25): features of the pairs with a common token.

    ov and ratio are the numbers of the buckets of the shared tokens and of their share in the
    option's distinct tokens. Pairs not listed have all counts, buckets and bm25 0.
    """
    sizes = options.select("oid", F.size(F.array_distinct(tokens(F.col("text")))).alias("size"))
    mine = contexts.select("qid", F.explode(token_bigrams(tokens(F.col("context")))).alias("g"))
    theirs = options.select("oid", F.explode(token_bigrams(tokens(F.col("text")))).alias("g"))
    pairs = mine.join(F.broadcast(theirs), "g").groupBy("qid", "oid").agg(F.count("*").alias("shared_bigrams"))
    rows = scores.join(F.broadcast(sizes), "oid").join(pairs, ["qid", "oid"], "left")
    ratio = F.least(F.floor(F.col("shared") * 10 / F.greatest(F.lit(1), F.col("size"))), F.lit(10)).cast("bigint")
    return rows.select("qid", "oid", "shared", F.least("shared", F.lit(5)).cast("bigint").alias("ov"), ratio.alias("ratio"), F.coalesce("shared_bigrams", F.lit(0)).cast("bigint").alias("shared_bigrams"), (F.least("bm25", F.lit(p.cap)) / p.scale).alias("bm25"))


def weighted_scores(contexts: DataFrame, options: DataFrame, idf: DataFrame, stats: DataFrame, w: dict[str, float], p: Selector = Selector()) -> DataFrame:
    """(qid, oid, score) of every option of each context by the learned weights ``w`` of features, by name.

    The same features as learn.Examples: bm25, shared tokens (x:), tokens of the option (o:), buckets of
    their number (ov:) and share (or:), a bias, shared pairs of tokens (xb:). Weights are as many as the
    options' tokens and pairs; they meet contexts in the joins by token and by pair.
    """
    spark = contexts.sparkSession
    learned = spark.createDataFrame([(k, float(v)) for k, v in w.items()] or [("", 0.0)], "feature string, value double")
    of = lambda prefix, name: learned.where(F.col("feature").startswith(prefix)).select(F.substring("feature", len(prefix) + 1, 1 << 20).alias(name), F.col("value").alias(f"{name}_value"))
    weights = token_weights(options, idf, stats, p)
    scores = bm25_scores(contexts, weights)
    asked = contexts.select("qid", F.explode(F.array_distinct(tokens(F.col("context")))).alias("w"))
    shared = asked.join(of("x:", "w"), "w").join(weights.select("w", "oid"), "w").groupBy("qid", "oid").agg(F.sum("w_value").alias("x"))
    pair = lambda df, key, text: df.select(key, F.explode(token_bigrams(tokens(F.col(text)))).alias("g"))
    pairs = pair(contexts, "qid", "context").join(of("xb:", "g"), "g").join(pair(options, "oid", "text"), "g").groupBy("qid", "oid").agg(F.sum("g_value").alias("xb"))
    own = options.select("oid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).join(of("o:", "w"), "w").groupBy("oid").agg(F.sum("w_value").alias("own"))
    rows = of_all_options(contexts, options, features(contexts, options, scores, p))
    rows = rows.join(shared, ["qid", "oid"], "left").join(pairs, ["qid", "oid"], "left").join(own, "oid", "left")
    bucket = lambda prefix, c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i in range(11) for x in (i, float(w.get(f"{prefix}{i}", 0.0))))), F.col(c).cast("int")), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.col("bm25") * float(w.get("bm25", 0.0)) + zero("x") + zero("xb") + zero("own") + bucket("ov:", "ov") + bucket("or:", "ratio") + float(w.get("bias", 0.0))
    return rows.select("qid", "oid", score.alias("score"))


def predictions(contexts: DataFrame, options: DataFrame, scores: DataFrame, p: Selector = Selector()) -> DataFrame:
    """(qid, choice, confidence, margin, ranking, z, top): the softmax over all options of each context.

    ranking has the options with a common token, best first, as (score, oid, p). Ties go to the lowest
    option, and so does a context without any common token. margin is the lead over the second
    option, or over 0 if there is one option only. Without options there is no row.
    """
    score = F.round(F.least("bm25", F.lit(p.cap)) / p.scale, 12)
    listed = scores.select("qid", "oid", score.alias("score"))
    ranked = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "oid"))).alias("r"))
    whole = options.agg(F.count("*").alias("n_options"), F.min("oid").alias("first"))
    rows = contexts.select("qid").join(ranked, "qid", "left").crossJoin(F.broadcast(whole)).where("n_options > 0")
    rows = rows.withColumn("r", F.coalesce("r", F.array().cast("array<struct<neg:double,oid:bigint>>")))
    rows = rows.withColumn("k", F.size("r")).withColumn("top", F.coalesce(-F.get("r", F.lit(0))["neg"], F.lit(0.0)))
    matched = F.aggregate("r", F.lit(0.0), lambda acc, x: acc + F.exp(-x["neg"] - F.col("top")))
    rows = rows.withColumn("z", matched + (F.col("n_options") - F.col("k")) * F.exp(-F.col("top")))
    prob = lambda s: F.exp(s - F.col("top")) / F.col("z")
    second = F.when(F.col("k") >= 2, prob(-F.get("r", F.lit(1))["neg"])).when(F.col("n_options") >= 2, prob(F.lit(0.0))).otherwise(F.lit(0.0))
    ranking = F.transform("r", lambda x: F.struct((-x["neg"]).alias("score"), x["oid"].alias("oid"), prob(-x["neg"]).alias("p")))
    choice = F.when(F.col("k") > 0, F.get("r", F.lit(0))["oid"]).otherwise(F.col("first"))
    confidence = 1.0 / F.col("z")
    return rows.select("qid", choice.alias("choice"), confidence.alias("confidence"), (confidence - second).alias("margin"), ranking.alias("ranking"), "z", "top")


def _oids(options: DataFrame) -> DataFrame:
    return F.broadcast(options.agg(F.array_sort(F.collect_list("oid")).alias("oids")))


def _whole(predicted: DataFrame, options: DataFrame) -> DataFrame:
    """(qid, ranking): every option of each context, best first, as (neg, oid, p); ties go to the lowest option.

    Options without a common token have score 0 and share exp(-top)/z each.
    """
    met = F.transform("ranking", lambda x: F.struct((-x["score"]).alias("neg"), x["oid"].alias("oid"), x["p"].alias("p")))
    others = F.array_except("oids", F.transform("ranking", lambda x: x["oid"]))
    rest = F.transform(others, lambda o: F.struct(F.lit(0.0).alias("neg"), o.alias("oid"), (F.exp(-F.col("top")) / F.col("z")).alias("p")))
    return predicted.crossJoin(_oids(options)).select("qid", F.array_sort(F.concat(met, rest)).alias("ranking"))


def probabilities(predicted: DataFrame, options: DataFrame) -> DataFrame:
    """(qid, oid, p) of every option of each context."""
    return _whole(predicted, options).select("qid", F.inline("ranking")).select("qid", "oid", "p")


def suggestions(predicted: DataFrame, options: DataFrame, most: int = 5) -> DataFrame:
    """(qid, rank, name, p): the best of all options of each context, p rounded to 4 digits."""
    top = _whole(predicted, options).select("qid", F.posexplode(F.slice("ranking", 1, most)).alias("rank", "r"))
    return top.select("qid", (F.col("rank") + 1).cast("bigint").alias("rank"), "r.oid", F.round("r.p", 4).alias("p")).join(F.broadcast(options.select("oid", "name")), "oid").select("qid", "rank", "name", "p")


def of_all_options(contexts: DataFrame, options: DataFrame, listed: DataFrame) -> DataFrame:
    """bm25_scores() or features() with a row for every context and option: 0 throughout without a common token."""
    kinds = {c: kind for c, kind in listed.dtypes if c not in ("qid", "oid")}
    found = listed.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("oid", F.struct(*kinds)))).alias("found"))
    pairs = contexts.select("qid").join(found, "qid", "left").crossJoin(_oids(options)).select("qid", "found", F.explode("oids").alias("oid"))
    pairs = pairs.select("qid", "oid", F.element_at("found", F.col("oid")).alias("x"))
    return pairs.select("qid", "oid", *(F.coalesce(F.col("x")[c], F.lit(0).cast(kind)).alias(c) for c, kind in kinds.items()))


def gated(predicted: DataFrame, p: Selector = Selector()) -> DataFrame:
    """predictions() with ``passed``: whether confidence and margin, rounded to 4 digits, are enough."""
    ok = (F.round("confidence", 4) >= p.least_confidence) & (F.round("margin", 4) >= p.least_margin)
    return predicted.withColumn("passed", ok)


def rule_picks(contexts: DataFrame, options: DataFrame) -> DataFrame:
    """(qid, name, opinion): the first option whose name, read with blanks, occurs in the context.

    Else the first whose bare name does, else the first option, without an opinion. Null contexts
    have no opinion.
    """
    names = options.agg(F.transform(F.array_sort(F.collect_list(F.struct("oid", "name"))), lambda x: x["name"]).alias("names"))
    rows = contexts.select("qid", F.lower(F.coalesce("context", F.lit(""))).alias("low")).crossJoin(F.broadcast(names))
    blank = lambda c: F.translate(c, "_", " ")
    spaced = F.filter("names", lambda n: F.contains(blank(F.col("low")), blank(F.lower(n))))
    bare = F.filter("names", lambda n: F.contains(F.col("low"), F.lower(n)))
    found = F.coalesce(F.get(spaced, F.lit(0)), F.get(bare, F.lit(0)))
    return rows.select("qid", F.coalesce(found, F.get("names", F.lit(0))).alias("name"), found.isNotNull().alias("opinion"))
