"""All queries of the core, by name: operators applied to whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.config import STOP_WORDS
from tidepool.functions import text as T
from tidepool.operators import evaluate, gates, graph, heat, journal, learn, recall, records, search, selector
from tidepool.operators.unpack import unpack_values
from tidepool.plans import oracle
from tidepool.plans.inputs import AS_OF, KEYWORD, KEYWORDS, OWNER, PROMPTS, SEEDS
from tidepool.streaming import turns as streams

Query = Callable[[SparkSession, str], DataFrame]

_registered: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "memories")


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed phrases, and the first run of letters of every memory whose id is divisible by 100."""
    some = _memories(spark, folder).where("id % 100 = 0").select(F.regexp_extract("content", KEYWORD, 0).alias("keyword")).where("keyword <> ''")
    return spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string").union(some).distinct()


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every label of every memory, with its position."""
    return unpack_values(_memories(spark, folder), "id", "tags")


# -- heat -----------------------------------------------------------------------------------------


@query
def heat_decay(spark, folder):
    return heat.decay(_memories(spark, folder), AS_OF).withColumn("new_heat", F.round("new_heat", 6))


@query
def heat_decay_summary(spark, folder):
    return heat.decay_summary(heat.decay(_memories(spark, folder), AS_OF))


@query
def heat_histogram(spark, folder):
    return heat.histogram(_memories(spark, folder))


@query
def heat_spark_pulse(spark, folder):
    return heat.pulse(_memories(spark, folder), F.col("hit_count")).withColumn("new_heat", F.round("new_heat", 6))


@query
def protected_rows(spark, folder):
    return _memories(spark, folder).where(heat.protected(F.col("layer"), F.col("tags"))).select("id")


# -- reading --------------------------------------------------------------------------------------


@query
def read_active(spark, folder):
    return records.active(_memories(spark, folder), OWNER)


@query
def read_recent(spark, folder):
    return records.recent(_memories(spark, folder))


@query
def read_recent_all_status(spark, folder):
    return records.recent(_memories(spark, folder), only_active=False, newest_first=True)


@query
def ledger_counts(spark, folder):
    return records.ledger(_memories(spark, folder))


@query
def identity_topk(spark, folder):
    return records.identity(_memories(spark, folder).where("layer = 'core'"), "confidence")


@query
def weak_points(spark, folder):
    return records.weak_topics(_memories(spark, folder), "source", "heat", "confidence")


@query
def std_object_preview(spark, folder):
    return records.previews(_memories(spark, folder))


@query
def owner_sequence(spark, folder):
    return records.numbered(_memories(spark, folder).select("owner", "id"), "owner", "id")


@query
def status_ledger(spark, folder):
    """State of the memories after superseding: an append-only ledger folded to the latest entries."""
    memories = _memories(spark, folder).where("status = 'active'")
    written = memories.select("id", F.lit(0).cast("bigint").alias("seq"), F.col("id").alias("at"), "status")
    replaced = gates.supersedes(memories).select(F.col("outdated").alias("id"), F.lit(1).cast("bigint").alias("seq"), F.col("id").alias("at"), F.lit("outdated").alias("status"))
    return gates.current_state(written.union(replaced)).select("id", "at", "status")


# -- writing --------------------------------------------------------------------------------------


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """(owner, counter, user, assistant): a memory as what the user says, the owner's next as the answer."""
    rows = records.numbered(_memories(spark, folder).select("owner", "id", "content"), "owner", "id", "counter")
    answers = rows.select("owner", (F.col("counter") - 1).alias("counter"), F.col("content").alias("assistant"))
    return rows.join(answers, ["owner", "counter"], "left").select("id", "owner", "counter", F.col("content").alias("user"), "assistant")


@query
def write_gates(spark, folder):
    return _memories(spark, folder).select("id", gates.gate(F.col("content")).alias("verdict"), gates.layer_of(F.col("tags")).alias("new_layer"))


@query
def turn_text(spark, folder):
    return _turns(spark, folder).select("id", gates.turn_text(F.col("user"), F.col("assistant")).alias("text"))


@query
def turn_tags(spark, folder):
    return _turns(spark, folder).select("id", gates.turn_tag(F.col("user"), F.col("counter")).alias("tag"))


@query
def event_time(spark, folder):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return _memories(spark, folder).select("id", T.event_time(F.col("content"), now).alias("event_time"))


@query
def dedup_window(spark, folder):
    return gates.duplicates_recent(_memories(spark, folder).where("status = 'active'")).withColumn("overlap", F.round("overlap", 6))


@query
def supersede(spark, folder):
    return gates.supersedes(_memories(spark, folder).where("status = 'active'")).withColumn("overlap", F.round("overlap", 6))


@query
def core_conflict(spark, folder):
    """Every hundredth memory, negated, against the core memories: those of which the opposite is core are blocked."""
    rows = _memories(spark, folder)
    new = rows.where("id % 100 = 0 OR layer = 'core'").select("id", "owner", F.concat(F.lit("不"), "content").alias("content"))
    return gates.core_conflicts(new, rows.where("layer = 'core'"))


# -- text -----------------------------------------------------------------------------------------


@query
def normalise(spark, folder):
    return _memories(spark, folder).select("id", T.normalised(F.col("content")).alias("text"))


@query
def char_bigrams(spark, folder):
    return _memories(spark, folder).select("id", F.size(T.char_bigrams(F.coalesce("content", F.lit("")))).cast("bigint").alias("n"))


@query
def bigram_overlap(spark, folder):
    rows = _turns(spark, folder).where("user IS NOT NULL AND assistant IS NOT NULL")
    sets = rows.select("id", T.bigram_codes(F.col("user")).alias("a"), T.bigram_codes(F.col("assistant")).alias("b"))
    return sets.select("id", F.round(T.overlap_rate(F.col("a"), F.col("b")), 6).alias("overlap"))


@query
def tokenize(spark, folder):
    return _memories(spark, folder).select("id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


@query
def token_bigrams(spark, folder):
    return _memories(spark, folder).select("id", F.array_join(F.array_sort(T.token_bigrams(T.tokens(F.col("content")))), " ").alias("bigrams"))


@query
def token_estimate(spark, folder):
    return _read(spark, folder, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query
def concept_extract(spark, folder):
    return _memories(spark, folder).select("id", F.array_join(T.concepts(F.col("content"), STOP_WORDS), " ").alias("concepts"))


@query
def core_keywords(spark, folder):
    core = _memories(spark, folder).where("layer = 'core'")
    runs = lambda c, n: F.explode(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"[一-鿿]{{2,{n}}}"), F.lit(0))).alias("keyword")
    return core.select(runs("content", 6)).union(core.select(runs("tags", 4))).distinct()


# -- search ---------------------------------------------------------------------------------------


@query
def fts_search(spark, folder):
    return search.phrase_search(_memories(spark, folder), _keywords(spark, folder), 10).withColumn("score", F.round("score", 6))


@query
def scan_search(spark, folder):
    return search.scan_search(_memories(spark, folder), _keywords(spark, folder), OWNER)


@query
def search_with_fallback(spark, folder):
    return search.search(_memories(spark, folder), _keywords(spark, folder), OWNER)


# -- selector -------------------------------------------------------------------------------------


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "gold").select(F.col("gold_id").alias("qid"), "context", "label")


def _selector(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Options, contexts, scores and predictions of the lexical selector fitted on the tools."""
    options = selector.option_texts(_read(spark, folder, "tools"))
    contexts = _contexts(spark, folder)
    scores = selector.bm25_scores(contexts, selector.token_weights(options, *selector.fit_lexical(options)))
    return options, contexts, scores, selector.predictions(contexts, options, scores)


def _decided(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    options, contexts, _, predicted = _selector(spark, folder)
    return evaluate.decided(contexts, predicted, options), selector.rule_picks(contexts, options)


@query
def option_catalogue(spark, folder):
    return selector.option_texts(_read(spark, folder, "tools"))


@query
def gold_known(spark, folder):
    """Gold rows whose label is an option."""
    names = _read(spark, folder, "tools").select(F.col("name").alias("label"))
    return _contexts(spark, folder).join(names, "label", "left_semi").select("qid", "context", "label")


@query
def stored_model(spark, folder):
    """Token weights of the stored model, with its statistics."""
    model = _read(spark, folder, "lex_model")
    return model.select(F.explode("lex.idf").alias("w", "idf"), F.col("lex.avgdl").alias("avgdl"), F.col("lex.n").cast("bigint").alias("n")).withColumn("idf", F.round("idf", 9))


@query
def idf_fit(spark, folder):
    idf, _ = selector.fit_lexical(selector.option_texts(_read(spark, folder, "tools")))
    return idf.withColumn("idf", F.round("idf", 9))


@query
def bm25_scores(spark, folder):
    options, contexts, scores, _ = _selector(spark, folder)
    return selector.of_all_options(contexts, options, scores).withColumn("bm25", F.round("bm25", 6))


@query
def selector_features(spark, folder):
    options, contexts, scores, _ = _selector(spark, folder)
    return selector.of_all_options(contexts, options, selector.features(contexts, options, scores)).withColumn("bm25", F.round("bm25", 6))


@query
def selector_probs(spark, folder):
    options, _, _, predicted = _selector(spark, folder)
    return selector.probabilities(predicted, options).withColumn("p", F.round("p", 6))


@query
def selector_predict(spark, folder):
    rounded = lambda c: F.round(c, 6).alias(c)
    return _selector(spark, folder)[3].select("qid", "choice", rounded("confidence"), rounded("margin"))


@query
def selector_topk(spark, folder):
    options, _, _, predicted = _selector(spark, folder)
    return selector.suggestions(predicted, options)


@query
def selector_gate(spark, folder):
    return selector.gated(_selector(spark, folder)[3]).select("qid", "choice", "passed")


@query
def rule_pick(spark, folder):
    options, contexts, _, _ = _selector(spark, folder)
    return selector.rule_picks(contexts, options)


@query
def eval_metrics(spark, folder):
    m = evaluate.metrics(_decided(spark, folder)[0])
    return m.select("n", "hits", *(F.round(c, 6).alias(c) for c in ("top1", "logloss", "ece")))


@query
def eval_per_class(spark, folder):
    return evaluate.per_class(_decided(spark, folder)[0]).withColumn("accuracy", F.round("accuracy", 6))


@query
def ece(spark, folder):
    return evaluate.calibration_error(_decided(spark, folder)[0]).withColumn("ece", F.round("ece", 6))


@query
def baselines(spark, folder):
    options, contexts, _, predicted = _selector(spark, folder)
    decided = evaluate.decided(contexts, predicted, options)
    rows = decided.select("qid", "label")
    out = evaluate.baselines(rows, rows, selector.rule_picks(contexts, options), decided, options.agg(F.count("*").alias("n_options")))
    return out.select("n", "majority", *(F.round(c, 6).alias(c) for c in ("majority_top1", "rule_top1", "bm25_top1", "random_top1")))


@query
def gate_sweep(spark, folder):
    return evaluate.gate_sweep(*_decided(spark, folder))


@query
def opinion_subsets(spark, folder):
    out = evaluate.by_opinion(*_decided(spark, folder))
    return out.select("opinion", "n", *(F.round(c, 6).alias(c) for c in ("selector_top1", "rule_top1")))


@query
def label_dist(spark, folder):
    return evaluate.label_counts(_read(spark, folder, "gold"), "label")


@query
def latency_percentiles(spark, folder):
    out = evaluate.latency(_read(spark, folder, "events"), "value")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "largest", "p95")))


@query
def learned_selector(spark, folder):
    return learn.learned(_contexts(spark, folder), selector.option_texts(_read(spark, folder, "tools")))


# -- graph ----------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "nodes")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "edges")


@query
def graph_load(spark, folder):
    return graph.adjacency(_edges(spark, folder))


@query
def graph_sense(spark, folder):
    texts = _read(spark, folder, "gold").select(F.col("gold_id").alias("qid"), F.col("context").alias("text"))
    return graph.sense(texts, _nodes(spark, folder))


@query
def graph_walk(spark, folder):
    some = _nodes(spark, folder).where("ord % 100 = 0").select((F.col("ord") + 1000).alias("qid"), F.lit(1).cast("bigint").alias("rank"), F.col("id").alias("node"))
    seeds = spark.createDataFrame(list(SEEDS), "qid bigint, rank bigint, node string").union(some)
    return graph.walk(seeds, graph.adjacency(_edges(spark, folder)))


@query
def prefetch(spark, folder):
    some = _read(spark, folder, "gold").where("gold_id % 100 = 0").select((F.col("gold_id") + 1000).alias("qid"), F.col("context").alias("text"))
    texts = spark.createDataFrame(list(PROMPTS), "qid bigint, text string").union(some)
    return recall.prefetch(texts, _memories(spark, folder), _nodes(spark, folder), graph.adjacency(_edges(spark, folder)), OWNER)


@query
def spread(spark, folder):
    some = _nodes(spark, folder).where("ord % 100 = 0").select((F.col("ord") + 1000).alias("qid"), F.col("id").alias("node"), F.lit(1.0).alias("strength"))
    seeds = spark.createDataFrame([(0, "n0", 1.0), (0, "n5", 0.5), (1, "n7", 1.0)], "qid bigint, node string, strength double").union(some)
    return graph.spread(seeds, graph.adjacency(_edges(spark, folder))).withColumn("strength", F.round("strength", 9))


@query
def cooccurrence(spark, folder):
    return graph.cooccurrence(_edges(spark, folder), "src", "relation")


@query
def label_cooccurrence(spark, folder):
    """Labels that occur together on memories."""
    return graph.cooccurrence(p6_found(spark, folder), "id", "tag")


@query
def theme_partition(spark, folder):
    return graph.partition(_edges(spark, folder))


# -- recall and journals --------------------------------------------------------------------------


@query
def recall_channels(spark, folder):
    memories = _memories(spark, folder)
    line = F.substring(F.coalesce("content", F.lit("")), 1, 25).alias("line")
    as_text = F.col("id").cast("string").alias("id")
    found = search.phrase_search(memories, spark.createDataFrame([("logbook",)], "keyword string"), 3)
    lit = found.join(memories.select("id", "content"), "id").select("rank", as_text, line)
    latest = records.recent(memories.where(F.col("owner") == OWNER), 3, newest_first=True).select("rank", as_text, line)
    weak = records.weak_topics(memories, "source", "heat", "confidence").where("topic IS NOT NULL")
    weak = weak.agg(F.array_sort(F.collect_set("topic")).alias("t")).select(F.posexplode("t").alias("rank", "line")).select((F.col("rank") + 1).alias("rank"), F.col("line").alias("id"), "line")
    identity = records.identity(memories.where("layer = 'core'"), "confidence").select("rank", as_text, "line")
    return recall.channels(identity=identity, lit=lit, premonition=latest, weak=weak)


@query
def turn_answer(spark, folder):
    """For each gold context the first channel with an answer: the gated tool, else the rule's."""
    options, contexts, _, predicted = _selector(spark, folder)
    sure = selector.gated(predicted).where("passed").join(F.broadcast(options), F.col("choice") == F.col("oid")).select("qid", F.col("name").alias("text"))
    return recall.first_channel(sure, selector.rule_picks(contexts, options).select("qid", F.col("name").alias("text")))


@query
def time_cover(spark, folder):
    return recall.cover(_memories(spark, folder).where(F.col("owner") == OWNER))


@query
def compress(spark, folder):
    return recall.compress(_memories(spark, folder), AS_OF)


@query
def hourly_narrative(spark, folder):
    return recall.narratives(_read(spark, folder, "events"), "ts", F.col("user_id"), "event_type")


def _journal(spark: SparkSession, folder: str) -> DataFrame:
    """Events as journal lines: a user is a run, an event's kind says what it is."""
    events = _read(spark, folder, "events")
    kind = F.when(F.col("event_type") == "signup", "task_start").when(F.col("event_type") == "error", "choice_shadow").when(F.col("event_type") == "purchase", "choice_shadow_result").otherwise("round")
    line = F.struct(
        F.col("user_id").cast("string").alias("run_id"), kind.alias("kind"), F.concat(F.lit("task "), F.col("event_id")).alias("task"),
        F.struct(F.array(F.lit("view"), F.lit("click")).alias("visible")).alias("vision"), F.col("event_type").alias("tool"), (F.col("value") > 50).alias("match"),
    )
    return journal.parse(events.select(F.col("event_id").alias("pos"), F.to_json(line).alias("value")))


@query
def journal_dataset(spark, folder):
    return journal.decisions(_journal(spark, folder)).withColumn("names", F.array_join("names", ","))


@query
def shadow_report(spark, folder):
    return journal.shadow_report(_journal(spark, folder)).withColumn("rate", F.round("rate", 6))


@query
def effect_ledger(spark, folder):
    turns = _turns(spark, folder)
    later = turns.select("owner", (F.col("counter") - 1).alias("counter"), F.col("assistant").alias("next_user"))
    rows = turns.join(later, ["owner", "counter"], "left").select("owner", F.col("user").alias("injected"), F.col("assistant").alias("answer"), "next_user")
    return journal.effects(rows)


@query
def stream_windows(spark, folder):
    """Hourly counts of events by a stream with a watermark, run over all that is there."""
    return streams.hourly(spark, f"{folder}/events.parquet")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return selector_predict(spark, folder)


def queries() -> dict[str, Query]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
