import math

import pytest
from pyspark.sql import functions as F

from tidepool.config import Write
from tidepool.operators import gates, heat, records, search

NOW = "2026-03-01 00:00:00"


def test_decay(memories):
    rows = memories(
        {"id": 1, "heat": 1.0, "last_sparked_at": "2026-02-27 00:00:00"}, {"id": 2, "heat": 1.0}, {"id": 3, "heat": 1.0, "last_sparked_at": "yesterday"},
        {"id": 4, "heat": 1.0, "last_sparked_at": "2026-03-09 00:00:00"}, {"id": 5, "heat": 0.2, "layer": "core", "last_sparked_at": NOW}, {"id": 6, "heat": 0.0}, {"id": 7},
        {"id": 8, "heat": 3.0, "tags": '["教训"]', "last_sparked_at": "2026-02-19 00:00:00"}, {"id": 9, "heat": 0.1, "last_sparked_at": NOW},
    )
    got = {r.id: r for r in heat.decay(rows, NOW).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8, 9}
    assert got[1].new_heat == pytest.approx(math.exp(-0.2)) and got[2].new_heat == got[3].new_heat == pytest.approx(math.exp(-0.1))
    assert got[4].new_heat == 1.0 and not got[4].changed
    assert got[5].new_heat == 0.5 and got[5].changed and not got[5].cold and got[9].cold
    assert got[8].new_heat == pytest.approx(3 * math.exp(-0.2))
    assert heat.decay_summary(heat.decay(rows, NOW)).first().asDict() == {"changed": 5, "protected": 2, "cold": 1}
    assert heat.decay(rows.limit(0), NOW).collect() == []


def test_histogram_bounds(memories):
    rows = memories(*({"id": i, "owner": "a", "heat": h} for i, h in enumerate([0.0, 0.1, 0.15, 0.5, 1.0, 2.0, 2.1, None])))
    r = heat.histogram(rows).first()
    assert (r.total, r.hot, r.sunk, r.over_2, r.over_1, r.over_half, r.under_half) == (8, 6, 1, 1, 1, 2, 2)


def test_pulse(memories):
    rows = memories({"id": 1, "heat": 4.9, "hit_count": 3}, {"id": 2})
    assert {r.id: r.new_heat for r in heat.pulse(rows, F.col("hit_count")).collect()} == {1: 5.0, 2: 0.0}


def test_recent_and_ledger(memories):
    rows = memories(*({"id": i, "owner": "a", "status": "active" if i % 2 else "outdated", "content": str(i)} for i in range(1, 9)), {"id": 99, "status": "active"})
    assert [r.id for r in records.recent(rows, 2).where("owner = 'a'").orderBy("rank").collect()] == [5, 7]
    assert [r.id for r in records.recent(rows, 2, False, True).where("owner = 'a'").orderBy("rank").collect()] == [8, 7]
    assert records.ledger(rows).first().asDict() == {"total": 9, "active": 5, "outdated": 4, "core": 0, "hot": 0}


def test_numbered_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 7)
    df = spark.createDataFrame([("a", i * i) for i in range(100)] + [("b", 5), (None, 6)], "owner string, id bigint")
    got = {(r.owner, r.id): r.seq for r in records.numbered(df, "owner", "id").collect()}
    assert got == {**{("a", i * i): i + 1 for i in range(100)}, ("b", 5): 1}
    assert records.numbered(df.limit(0), "owner", "id").collect() == []


def test_gates(spark):
    texts = {"abcd": "shell", "abcde": "pass", "用户：\n助手： ": "shell", None: "shell", "": "shell", **{f"x {m} y": "noise" for m in Write().noise}, "review the conversation above": "pass"}
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert {r.t: r.v for r in df.select("t", gates.gate(F.col("t")).alias("v")).collect()} == texts


def test_turns(spark):
    df = spark.createDataFrame([(1, "记得", 1), (2, "我记得修代码", 2), (3, "修代码", 3), (4, "父令", 4), (5, None, 5)], "id int, u string, k int")
    got = [r.t for r in df.orderBy("id").select(gates.turn_tag(F.col("u"), F.col("k")).alias("t")).collect()]
    assert got == ["对话开始", "记忆·对话", "技术·对话", "父令·对话", "对话记录"]
    text = df.limit(1).select(gates.turn_text(F.lit("x" * 400), F.lit(None).cast("string")).alias("t")).first().t
    assert text == "用户：" + "x" * 300 + "\n助手："


def test_duplicates_and_superseding(memories):
    base = "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸子丑寅卯"
    rows = memories(
        {"id": 1, "owner": "a", "content": base}, {"id": 2, "owner": "a", "content": base + "，"}, {"id": 3, "owner": "a", "content": base[:-2] + "xy"},
        {"id": 4, "owner": "b", "content": base}, {"id": 5, "owner": "a", "content": None}, {"id": 6, "owner": None, "content": base}, {"id": 7, "owner": "b", "content": "short"},
        {"id": 8, "owner": "c", "content": base, "tags": "经验总结"}, {"id": 9, "owner": "c", "content": base},
    )
    assert {(r.id, r.duplicate_of) for r in gates.duplicates_recent(rows).collect()} == {(2, 1), (9, 8)}
    assert {(r.id, r.outdated) for r in gates.supersedes(rows).collect()} == {(2, 1), (3, 2)}


def test_state_never_loses_a_row(spark):
    df = spark.createDataFrame([(1, 0, 1, "active"), (1, 1, 5, "outdated"), (2, 0, 2, "active")], "id int, seq int, at int, status string")
    assert {(r.id, r.status) for r in gates.current_state(df).collect()} == {(1, "outdated"), (2, "active")}


def test_phrase_search(spark, memories):
    rows = memories(
        {"id": 1, "owner": "a", "status": "active", "content": "aaaaa"}, {"id": 2, "owner": "a", "status": "outdated", "content": "x AAA", "tags": "aaa"}, {"id": 3, "owner": "b", "status": "active", "content": "ab", "tags": "cd"},
        {"id": 4, "owner": "a", "status": "active", "content": None, "tags": "zz top"}, {"id": 5, "owner": "a", "status": "active", "content": ""}, {"id": 6, "owner": "a", "status": "active", "content": "x.*y\\Ez"},
    )
    words = spark.createDataFrame([(x,) for x in ("aaa", "abcd", "zz", "zz t", "", '.*y\\E')], "keyword string")
    got = {(r.keyword, r.rank): (r.id, r.score) for r in search.phrase_search(rows, words).collect()}
    assert {k: v[0] for k, v in got.items()} == {("aaa", 1): 1, ("aaa", 2): 2, ("zz t", 1): 4, (".*y\\E", 1): 6}
    n, dl = 6, [3, 4, 0, 4, 0, 5]
    idf = math.log((n - 2 + 0.5) / 2.5)
    for place, (tf, d) in enumerate([(3, 3), (2, 4)], 1):
        assert got["aaa", place][1] == pytest.approx(-idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / (sum(dl) / n))), abs=1e-8)
    both = {(r.keyword, r.id) for r in search.search(rows, words, "a").collect()}
    assert both == {("aaa", 1), ("aaa", 2), ("zz t", 4), ("zz", 4), (".*y\\E", 6)}


def test_phrase_in_most_rows_has_a_small_positive_weight(spark, memories):
    rows = memories(*({"id": i, "content": "the same"} for i in range(4)))
    score = search.phrase_search(rows, spark.createDataFrame([("same",)], "keyword string")).first().score
    assert -1e-5 < score < 0
