"""Command line of the option selector: python -m tidepool.selector_cli COMMAND ...

    predict MODEL --context TEXT --option A --option B    chances of options
    train ROWS --out MODEL      weights learned from decision rows (JSON lines of context, options, label)
    eval MODEL ROWS             hits, log loss and calibration of a model on decision rows
    build | bench | default | behavior [--gold FILE | --journal FILE] --tools FILE
                                labelled rows there are; report; the default model to --out; gates and their gain
    shadow --journal FILE [--last N]
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.config import Training
from tidepool.operators import evaluate, journal, learn, selector
from tidepool.sources import stores

ROWS = "context string, options array<string>, label int"


def _corpus(rows: DataFrame) -> list[str]:
    """The distinct option texts of decision rows; too many to train on are an error."""
    texts = [r[0] for r in rows.select(F.explode("options").alias("o")).distinct().orderBy("o").limit(learn.MOST_OPTIONS + 1).collect()]
    if len(texts) > learn.MOST_OPTIONS:
        raise ValueError(f"more than {learn.MOST_OPTIONS} options")
    return texts


def _labelled(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (qid, context, label) of a gold file or a journal, and the options."""
    options = stores.read_tools(spark, a.tools)
    if a.gold:
        return stores.read_gold(spark, a.gold, options), options
    runs = journal.decisions(stores.read_journal(spark, a.journal))
    rows = runs.select(F.xxhash64("run_id").alias("qid"), "context", F.col("gold").alias("label"))
    return rows.join(options.select(F.col("name").alias("label")), "label", "left_semi"), options


def _predicted(rows: DataFrame, options: DataFrame) -> DataFrame:
    scores = selector.bm25_scores(rows, selector.token_weights(options, *selector.fit_lexical(options)))
    return selector.predictions(rows, options, scores)


def predict(model: dict, context: str, options: list[str]) -> str:
    p = learn.Scorer.of(model).chances(context, options)
    order = sorted(range(len(p)), key=lambda i: (-p[i], i))
    lines = [f"{p[i]:.4f}  {options[i]}" for i in order]
    margin = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0) if order else 0.0
    return "\n".join([*lines, f"choice {options[order[0]] if order else '-'}, confidence {p[order[0]] if order else 0:.3f}, margin {margin:.3f}"])


def train(rows: DataFrame, out: str, t: Training) -> str:
    """Learn weights on at most learn.SAMPLE rows, by a hash of their context, and store them."""
    some = rows.where("label >= 0 AND label < size(options)").orderBy(F.xxhash64("context"), "context", "label").limit(learn.SAMPLE).collect()
    corpus = _corpus(rows)
    place = {o: i for i, o in enumerate(corpus)}
    m = learn.train([(r.context, place[r.options[r.label]]) for r in some], corpus, t=t)
    lex = learn.Lexicon.fit(corpus)
    stores.save_model(out, m["w"], m["b"], {"rows": len(some), "epochs": t.epochs}, lex.idf, lex.avgdl, lex.n)
    return f"{len(some)} rows, {len(m['w'])} weights, model {out}"


def bench(rows: DataFrame, options: DataFrame) -> str:
    """The whole report of the lexical selector, and of a learned one on a rounded split."""
    known = learn.catalogue(options)
    place = {name: i for i, (name, _) in enumerate(known)}
    some = sorted((r.context, place[r.label]) for r in rows.orderBy(F.xxhash64("qid"), "qid").limit(learn.SAMPLE).collect())
    head, test = learn.split(some, seed=7, rounded=True)
    first, check = learn.split(head, 0.25, seed=8, rounded=True)
    m = learn.train(first, [x for _, x in known], check)
    lex = learn.Lexicon.fit([x for _, x in known])
    top1 = lambda w: sum(int(learn.Scorer(w, lex).chances(c, [x for _, x in known]).argmax()) == label for c, label in test) / max(1, len(test))
    out = evaluate.report(rows, _predicted(rows, options), options, selector.rule_picks(rows, options))
    return json.dumps(out | {"n_train": len(head), "n_test": len(test), "lexical_top1": top1({"bm25": 1.0}), "learned_top1": top1(m["w"]), "weights": len(m["w"])}, ensure_ascii=False, indent=2, default=str)


def default(options: DataFrame, out: str, n: int) -> str:
    """Store the default model: the lexical score alone, fitted on the options."""
    lex = learn.Lexicon.fit([x for _, x in learn.catalogue(options)])
    stores.save_model(out, {"bm25": 1.0}, 0.0, {"rows": n}, lex.idf, lex.avgdl, lex.n)
    return f"{n} rows, {len(lex.idf)} tokens, model {out}"


def behavior(rows: DataFrame, options: DataFrame) -> str:
    done = evaluate.decided(rows, _predicted(rows, options), options)
    return "\n".join(json.dumps(r.asDict()) for r in evaluate.gate_sweep(done, selector.rule_picks(rows, options)).orderBy("threshold").collect())


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("predict", "train", "eval", "build", "bench", "default", "behavior", "shadow"))
    parser.add_argument("files", nargs="*")
    for name in ("context", "gold", "journal", "tools", "out"):
        parser.add_argument(f"--{name}", default="")
    parser.add_argument("--option", action="append", default=[])
    parser.add_argument("--epochs", type=int, default=Training().epochs)
    parser.add_argument("--rate", type=float, default=Training().rate)
    parser.add_argument("--last", type=int)
    a = parser.parse_args(args)
    if a.command == "predict":
        return predict(_model(a.files[0]), a.context, a.option)
    spark = SparkSession.builder.appName("tidepool").getOrCreate()
    if a.command in ("train", "eval"):
        rows = spark.read.schema(ROWS).json(a.files[-1])
        if a.command == "train":
            return train(rows, a.out, replace(Training(), epochs=a.epochs, rate=a.rate))
        return json.dumps(evaluate.metrics(learn.decided(rows, learn.Scorer.of(_model(a.files[0])))).first().asDict())
    if a.command == "shadow":
        return json.dumps(journal.shadow_report(stores.read_journal(spark, a.journal), last=a.last).first().asDict())
    rows, options = _labelled(spark, a)
    if a.command == "build":
        return f"{rows.count()} rows, {options.count()} options"
    if a.command == "default":
        return default(options, a.out, rows.count())
    return bench(rows, options) if a.command == "bench" else behavior(rows, options)


if __name__ == "__main__":
    print(main())
