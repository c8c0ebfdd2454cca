import json
import math
import os

import pytest

from tidepool import selector_cli as cli
from tidepool.config import Training
from tidepool.operators import evaluate, learn, selector
from tidepool.sources import stores


def setting(spark, tools, contexts):
    options = selector.option_texts(spark.createDataFrame(tools, "name string, description string"))
    rows = spark.createDataFrame(contexts, "qid bigint, context string, label string")
    scores = selector.bm25_scores(rows, selector.token_weights(options, *selector.fit_lexical(options)))
    return options, rows, scores, selector.predictions(rows, options, scores)


TOOLS = [("read_page", "opens a page 读"), ("list_shelf", "lists a shelf"), ("zip", None)]


def brute(tools, context):
    """The same probabilities by the closed formula, one context at a time."""
    names = sorted(n for n, _ in tools)
    docs = [learn.words((n + " " + (dict(tools)[n] or "")).strip()) for n in names]
    lex = learn.Lexicon.fit([" ".join(d) for d in docs])
    scores = []
    for d in docs:
        s = sum(lex.idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / lex.avgdl)) for w in set(learn.words(context)) if w in d)
        scores.append(min(s, 40) / 20)
    e = [math.exp(s - max(scores)) for s in scores]
    return names, [x / sum(e) for x in e]


def test_predictions_against_formula(spark):
    contexts = [(1, "open the page", "read_page"), (2, "shelf or page?", "list_shelf"), (3, "nothing", "zip"), (4, None, "zip"), (5, "", "unknown"), (6, "读 a", None)]
    options, rows, _, predicted = setting(spark, TOOLS, contexts)
    got = {r.qid: r for r in predicted.collect()}
    assert len(got) == 6
    for qid, context, _ in contexts:
        names, p = brute(TOOLS, context)
        best = max(range(3), key=lambda i: (round(p[i], 12), -i))
        second = sorted(p, reverse=True)[1]
        assert got[qid].choice == best and got[qid].confidence == pytest.approx(p[best]) and got[qid].margin == pytest.approx(p[best] - second, abs=1e-12)
        for x in got[qid].ranking:
            assert x.p == pytest.approx(p[x.oid])
    assert {r.qid for r in selector.gated(predicted).where("passed").collect()} <= set(got)
    decided = evaluate.decided(rows, predicted, options)
    assert {r.qid for r in decided.collect()} == {1, 2, 3, 4}
    m = evaluate.metrics(decided).first()
    logloss = sum(-math.log(brute(TOOLS, c)[1][sorted(n for n, _ in TOOLS).index(label)]) for _, c, label in contexts[:4]) / 4
    assert m.n == 4 and m.logloss == pytest.approx(logloss)


def test_options_without_a_common_token_are_listed(spark):
    contexts = [(1, "open the page", None), (2, "nothing", None), (3, None, None)]
    options, rows, scores, predicted = setting(spark, TOOLS, contexts)
    probs = {(r.qid, r.oid): r.p for r in selector.probabilities(predicted, options).collect()}
    assert len(probs) == 9
    top = sorted((r.qid, r["rank"], r.name) for r in selector.suggestions(predicted, options, 2).collect())
    for qid, context, _ in contexts:
        names, p = brute(TOOLS, context)
        assert [probs[qid, i] for i in range(3)] == pytest.approx(p)
        order = sorted(range(3), key=lambda i: (-round(p[i], 12), i))
        assert [x for x in top if x[0] == qid] == [(qid, k + 1, names[order[k]]) for k in (0, 1)]
    for listed in (scores, selector.features(rows, options, scores)):
        known, whole = {(r.qid, r.oid): r for r in listed.collect()}, selector.of_all_options(rows, options, listed).select(listed.columns)
        assert 0 < len(known) < 9 and whole.dtypes == listed.dtypes
        got = {(r.qid, r.oid): r for r in whole.collect()}
        assert len(got) == 9 and all(r == known[k] if k in known else set(r[2:]) == {0} for k, r in got.items())


def test_report(spark):
    options, rows, _, predicted = setting(spark, TOOLS, [(1, "open the page", "read_page"), (2, "x", "zip")])
    r = evaluate.report(rows, predicted, options, selector.rule_picks(rows, options))
    assert r["metrics"]["n"] == r["baselines"]["n"] == 2 and len(r["sweep"]) == 7 and r["baselines"]["majority"] == "read_page"


def test_single_and_no_option(spark):
    _, _, _, one = setting(spark, [("a_b", "x")], [(1, "x", "a_b")])
    r = one.first()
    assert (r.choice, r.confidence, r.margin) == (0, 1.0, 1.0)
    assert setting(spark, [], [(1, "x", "a")])[3].collect() == []


def test_rule(spark):
    options, rows, _, _ = setting(spark, TOOLS, [(1, "please List Shelf", None), (2, "use list_shelf", None), (3, "none", None), (4, None, None)])
    got = {r.qid: (r.name, r.opinion) for r in selector.rule_picks(rows, options).collect()}
    assert got == {1: ("list_shelf", True), 2: ("list_shelf", True), 3: ("list_shelf", False), 4: ("list_shelf", False)}


def test_calibration_bins(spark):
    rows = spark.createDataFrame([(1.0, True), (0.95, False), (0.05, True)], "confidence double, ok boolean")
    assert evaluate.calibration_error(rows).first().ece == pytest.approx((2 * abs(0.5 - 0.975) + abs(1 - 0.05)) / 3)
    assert evaluate.calibration_error(rows.limit(0)).first().ece == 0.0


def test_latency_place(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double")
    r = evaluate.latency(rows, "v").first()
    assert (r.n, r.median, r.largest, r.p95) == (100, 50.5, 100.0, 95.0)


def test_training_goes_down_the_loss_unless_told_to_climb():
    rows = [("page", 0), ("shelf", 1)] * 4
    options = ["alpha page", "beta shelf"]
    down = learn.train(rows, options, t=Training(epochs=5))["loss_curve"]
    up = learn.train(rows, options, t=Training(epochs=5, ascend=True))["loss_curve"]
    assert down[-1] < down[0] and up[-1] > up[0]
    kept = learn.train(rows, options, rows, Training(epochs=2))
    assert kept["best_epoch"] == 0 and kept["w"] == {"bm25": 1.0}


def test_split_sizes():
    train, test = learn.split(list(range(92)))
    assert len(learn.split(list(range(92)), rounded=True)[1]) == 28
    assert (len(train), len(test)) == (65, 27) and sorted(train + test) == list(range(92)) and len(learn.split([1])[1]) == 1


def test_files(spark, tmp_path):
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"context": "a", "label": "x"}\n\n{"context": "b", "label": "y"}\n', encoding="utf-8")
    assert [(r.qid, r.context) for r in stores.read_gold(spark, str(gold)).orderBy("qid").collect()] == [(0, "a"), (1, "b")]
    names = spark.createDataFrame([("y",)], "name string")
    assert [r.qid for r in stores.read_gold(spark, str(gold), names).collect()] == [1]
    tools = tmp_path / "tools.json"
    tools.write_text(json.dumps({"tools": [{"name": "b", "description": "d"}, {"name": "a", "description": ""}]}), encoding="utf-8")
    assert [(r.oid, r.text) for r in stores.read_tools(spark, str(tools)).orderBy("oid").collect()] == [(0, "b d"), (1, "a")]
    path = stores.save_model(str(tmp_path / "m.json"), {"bm25": 1.0}, 0.0, {"k": 1}, {"w": 0.5}, 2.0, 3)
    m = stores.read_model(spark, path).first()
    assert m.w == {"bm25": 1.0} and m.lex.idf == {"w": 0.5} and (m.lex.avgdl, m.lex.n) == (2.0, 3)


def test_learned_weights_score_tables(spark):
    options, rows, _, _ = setting(spark, TOOLS, [(1, "open the page 读", None), (2, "lists a shelf zip", None), (3, None, None)])
    known = learn.catalogue(options)
    m = learn.train([("open a page", 0), ("a shelf list", 0), ("zip it", 2)], [x for _, x in known], t=Training(epochs=3))
    lex = learn.Lexicon.fit([x for _, x in known])
    got = {(r.qid, r.oid): r.score for r in selector.weighted_scores(rows, options, *selector.fit_lexical(options), m["w"]).collect()}
    assert len(got) == 9 and any(k.startswith("xb:") for k in m["w"])
    for r in rows.collect():
        e = [math.exp(got[r.qid, i]) for i in range(3)]
        assert [x / sum(e) for x in e] == pytest.approx(list(learn.Scorer(m["w"], lex).chances(r.context, [x for _, x in known])))


def test_selector_commands(spark, tmp_path):
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8") and str(tmp_path / name)
    tools = put("tools.json", [{"tools": [{"name": n, "description": d} for n, d in TOOLS]}])
    gold = put("gold.jsonl", [{"context": f"open the page {i}", "label": "read_page"} for i in range(10)] + [{"context": "shelf", "label": "unknown"}])
    log = put("journal.jsonl", [{"run_id": "r", "kind": "task_start", "task": "open the page", "vision": {"visible": ["read_page", "zip"]}}, {"run_id": "r", "kind": "round", "tool": "read_page"}, {"kind": "a_shadow_result", "match": True}, {"kind": "a_shadow_result", "match": False}, {"kind": "a_shadow"}])
    rows = put("rows.jsonl", [{"context": "page", "options": ["alpha page", "beta shelf"], "label": 0}, {"context": "shelf", "options": ["beta shelf"], "label": 0}, {"context": "x", "options": ["y"], "label": 4}])
    model = str(tmp_path / "m.json")
    assert cli.main(["train", rows, "--out", model, "--epochs", "2"]).startswith("2 rows")
    assert json.loads(cli.main(["eval", model, rows]))["n"] == 2
    assert cli.main(["predict", model, "--context", "page", "--option", "beta shelf", "--option", "alpha page"]).splitlines()[0].endswith("alpha page")
    assert cli.main(["build", "--gold", gold, "--tools", tools]) == "10 rows, 3 options" and cli.main(["build", "--journal", log, "--tools", tools]) == "1 rows, 3 options"
    report = json.loads(cli.main(["bench", "--gold", gold, "--tools", tools]))
    assert (report["n_train"], report["n_test"], report["lexical_top1"], report["metrics"]["hits"]) == (7, 3, 1.0, 10)
    assert cli.main(["default", "--gold", gold, "--tools", tools, "--out", model]).startswith("10 rows") and stores.read_model(spark, model).first().w == {"bm25": 1.0}
    assert len(cli.main(["behavior", "--gold", gold, "--tools", tools]).splitlines()) == 7
    assert json.loads(cli.main(["shadow", "--journal", log]))["rate"] == 0.5 and json.loads(cli.main(["shadow", "--journal", log, "--last", "1"]))["rate"] == 0.0


DATA = os.environ.get("SELECTOR_DATA", "")


@pytest.mark.skipif(not DATA, reason="SELECTOR_DATA names no folder with gold.jsonl and tools.json")
def test_published_accuracy(spark):
    options = stores.read_tools(spark, f"{DATA}/tools.json")
    rows = stores.read_gold(spark, f"{DATA}/gold.jsonl")
    scores = selector.bm25_scores(rows, selector.token_weights(options, *selector.fit_lexical(options)))
    decided = evaluate.decided(rows, selector.predictions(rows, options, scores), options)
    m = evaluate.metrics(decided).first()
    assert (m.n, m.hits) == (92, 61) and m.logloss == pytest.approx(2.796381, abs=1e-5) and m.ece == pytest.approx(0.594075, abs=1e-5)
    gate = decided.where("confidence >= 0.05 AND margin >= 0.03")
    assert (gate.count(), gate.where("ok").count()) == (20, 20)
