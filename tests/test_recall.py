import json

import pytest

from pyspark.sql import functions as F

from tidepool.api import Engine
from tidepool.cli import COMMANDS, run
from tidepool.operators import journal, recall
from tidepool.sources import stores
from tidepool.streaming import turns

NOW = "2026-03-01 00:00:00"


def test_journal(spark, tmp_path):
    lines = [
        {"run_id": "a", "kind": "task_start", "task": "old", "vision": {"visible": ["x"]}}, {"run_id": "a", "kind": "round", "tool": "finish"}, {"run_id": "a", "kind": "round", "tool": "y"},
        {"run_id": "a", "kind": "task_start", "task": "new", "vision": {"visible": ["x", "y"]}}, {"run_id": "a", "kind": "round", "tool": "x"}, {"run_id": "b", "kind": "task_start", "task": "t", "vision": {"visible": ["x"]}},
        {"run_id": "b", "kind": "round", "tool": "z"}, {"run_id": None, "kind": "round", "tool": "x"}, {"kind": "choice_shadow"}, {"kind": "choice_shadow_result", "match": True}, {"kind": "choice_shadow_result"},
    ]
    path = tmp_path / "j.jsonl"
    path.write_text("\n".join(["", "{broken", *map(json.dumps, lines)]), encoding="utf-8")
    rows = stores.read_journal(spark, str(path))
    assert [(r.run_id, r.context, r.names, r.gold) for r in journal.decisions(rows).collect()] == [("a", "new", ["x", "y"], "y")]
    assert journal.shadow_report(rows).first().asDict() == {"suggestions": 1, "results": 2, "matched": 1, "rate": 0.5}
    none = stores.read_journal(spark, str(tmp_path / "none"))
    assert journal.decisions(none).collect() == [] and journal.shadow_report(none).first().rate is None


def test_effects(spark):
    df = spark.createDataFrame([("o", "tea", "I like Tea", "没错"), ("o", "", "x", "不对, 没错"), ("o", "a", None, None)], "owner string, injected string, answer string, next_user string")
    assert journal.effects(df).first().asDict() == {"owner": "o", "cited": 1, "confirmed": 1, "corrected": 1, "score": 1}


def test_cover(memories):
    rows = memories(*({"id": i} for i in range(1, 1001)))
    ages = sorted(r.age_rank for r in recall.cover(rows, 20).collect())
    assert ages[:10] == list(range(1, 11)) and ages[-1] == 1000 and len(ages) == 20
    assert sorted(r.id for r in recall.cover(rows.limit(3), 20).collect()) == [1, 2, 3] and recall.cover(rows.limit(0), 20).collect() == []


def test_compress(memories):
    rows = memories({"id": 1, "created_at": "2026/01/01 00:00:00", "content": "x" * 50}, {"id": 2, "created_at": "2026-02-27T00:00:00", "content": "x" * 50}, {"id": 3, "created_at": "2026-01-01 00:00:00", "content": "x" * 50, "layer": "core"}, {"id": 4, "created_at": "2026-01-01 00:00:00"}, {"id": 5, "content": "y" * 99})
    assert {r.id: r.compressed for r in recall.compress(rows, NOW).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_channels_and_lists(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (9, "b", "y")], "rank int, id string, line string")
    assert [(r.channel, r.id) for r in recall.channels(weak=rows, lit=rows).orderBy("channel_rank").collect()] == [("lit", "a"), ("weak", "a")]
    texts = [spark.createDataFrame(x, "qid int, text string") for x in ([(1, "")], [(1, "b"), (2, "c")])]
    assert {(r.qid, r.channel, r.text) for r in recall.first_channel(*texts).collect()} == {(1, 2, "b"), (2, 2, "c")}
    assert recall.memory_list({"n": 1, "x": [{"id": 2}], "related": [{"id": 3}]}) == [{"id": 3}] and recall.memory_list({"x": [1]}) == []


def test_json_store(spark, tmp_path, memories):
    path = str(tmp_path / "store")
    rows = memories({"id": 2, "ts": "t2", "tags": "b", "content": "second"}, {"id": 1, "ts": "t1", "tags": "a", "content": "first"})
    stores.write_json_store(rows.select("id", "ts", "tags", "content"), path, NOW)
    back = stores.read_json_store(spark, path)
    assert [(r.id, r.tags, r.content) for r in stores.last_entries(back, 5).collect()] == [(1, "a", "first"), (2, "b", "second")]
    assert [r.id for r in stores.last_entries(back, 1).collect()] == [2]
    assert stores.active_or_json(rows.limit(0), back).count() == 2 and stores.active_or_json(rows.limit(1), back).count() == 1
    assert stores.read_json_store(spark, path + "-none").collect() == []


def test_engine_and_commands(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "编译器", None, 0)], "id string, title string, type string, ord bigint")
    edges = spark.createDataFrame([("n1", "n2", "r", 0)], "src string, dst string, relation string, ord bigint")
    engine = Engine(spark, str(tmp_path / "memories"), nodes, edges)
    assert not engine.available and engine.memories.count() == 0 and "no memories" in engine.system_block()
    text = "昨天我们修好了编译器的缓存目录，记住这一点不要再忘记"
    first = spark.createDataFrame([(1, text, "教训"), (2, text + "。", "x"), (3, "abc", "x"), (4, "User correction here", "x")], "place bigint, content string, tag string")
    assert {r.place: r.verdict for r in engine.write(first, NOW).collect()} == {1: "saved", 2: "duplicate:1", 3: "shell", 4: "noise"}
    row = engine.memories.first()
    assert (row.layer, row.event_time, row.created_at, row.self_relevance) == ("core", "2026-02-28 00:00:00", NOW, None)
    again = json.loads(engine.call("save", {"content": text}, NOW))
    assert again == {"status": "duplicate:1", "id": None}
    newer = text.replace("不要", "不可")
    assert json.loads(engine.call("save", {"content": newer}, NOW))["status"] == "saved"
    assert {r.id: r.status for r in engine.state().collect()} == {1: "outdated", 2: "active"} and engine.memories.count() == 2
    found = json.loads(engine.call("recall", {"query": "编译器"}, NOW))["results"]
    assert [x["id"] for x in found] == [1, 2] and "error" in json.loads(engine.call("x", {}, NOW))
    assert engine.recall("编译器")["hit"] and engine.health()["rows"] == 2 and len(engine.tools()) == 2
    # readers see what was superseded, and what contradicts a core memory is not written
    assert [r.id for r in engine.light("编译器").collect()] == [2] and engine.overview().first().outdated == 1
    assert json.loads(engine.call("save", {"content": "缓存目录保存在磁盘甲的上面", "tags": "教训"}, NOW))["id"] == 3
    assert json.loads(engine.call("save", {"content": "缓存目录不保存在磁盘甲的上面"}, NOW)) == {"status": "blocked:3", "id": None}
    assert engine.recall("编译器")["weak"] == ["缓存目录保存在磁盘甲的上面"] and engine.top_concepts("zzz 缓存目录 zzz") == ["缓存目录", "zzz", "zzz"]
    assert [r.id for r in engine.identity_line("缓存目录").collect()] == [3]
    assert engine.turn("编译器", ("编译器", "编译器好了"))[0] == "lit" and engine.turn("别的事情没有人知道")[0] == "premonition" and engine.turn("") == ("none", "")
    assert spark.read.parquet(f"{tmp_path}/memories_effects").first().cited == 1
    assert engine.organise(19) is None and engine.organise(20).count() == 1
    # heat that has cooled is what is read next
    stores.append_ledger(spark.createDataFrame([(2, 0, "2026-01-01 00:00:00", 2.0)], "id bigint, seq bigint, at string, heat double"), engine.path)
    assert engine.decay("2026-03-02 00:00:00").first().new_heat == pytest.approx(2.0 * 2.718281828 ** -0.1)
    assert {r.id: round(r.heat, 3) for r in engine.state().collect()}[2] == round(2.0 * 2.718281828 ** -0.1, 3)
    for command in COMMANDS:
        assert isinstance(run(engine, command, "编译器", "x", NOW), str)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("o", 1, "记得浇花", "好的", NOW), ("o", 2, "", "", NOW), ("p", 2, "User correction", "x", NOW)]
    spark.createDataFrame(rows, "owner string, counter bigint, user string, assistant string, at string").write.parquet(source)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("owner string, counter bigint, user string, assistant string, at string").parquet(source)
    turns.ingest(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "state")).awaitTermination()
    assert [(r.owner, r.tags) for r in spark.read.parquet(f"{out}/*").collect()] == [("o", '["对话开始"]')]


def test_stateful_stream(spark, tmp_path):
    source, kept = str(tmp_path / "in"), []
    spark.createDataFrame([("o", "the very same text"), ("o", "the very same, text"), ("p", "the very same text"), (None, "x")], "owner string, content string").coalesce(1).write.parquet(source)
    stream = turns.fresh_turns(spark.readStream.schema("owner string, content string").parquet(source))
    stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, n: kept.extend(df.collect())).start().awaitTermination()
    assert sorted((r.owner, r.duplicate) for r in kept) == [("o", False), ("o", True), ("p", False)]


def test_narrative(spark):
    df = spark.createDataFrame([("2026-01-01 10:10:00", 1, "b"), ("2026-01-01 10:05:00", 1, "a"), ("2026-01-01 11:00:00", 1, "a")], "t string, u int, k string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert sorted((str(r.hour), r.n, r.kinds, r.first_kind) for r in recall.narratives(df, "ts", F.col("u"), "k").collect()) == [("2026-01-01 10:00:00", 2, 2, "a"), ("2026-01-01 11:00:00", 1, 1, "a")]
