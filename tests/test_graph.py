import json
import random

import pytest

from tidepool.config import Walk
from tidepool.operators import graph, recall
from tidepool.sources import stores

NODES = "id string, title string, type string, ord bigint"
EDGES = "src string, dst string, relation string, ord bigint"


def fifo(seeds, edges, depth=2, most=8):
    """Breadth-first walk with a queue, as a check of the level-wise one."""
    near = {}
    for s, d, r in edges:
        near.setdefault(s, []).append((d, r))
        near.setdefault(d, []).append((s, r))
    met, queue, out = set(seeds), [(s, 0) for s in seeds], []
    while queue and len(out) < most:
        node, level = queue.pop(0)
        if level < depth:
            for other, r in near.get(node, []):
                if other not in met:
                    met.add(other)
                    out.append((len(out) + 1, other, r, level + 1))
                    queue.append((other, level + 1))
    return out


def test_walk_equals_a_queue_on_random_graphs(spark):
    rnd = random.Random(5)
    rows, seeds, expected = [], [], {}
    for q in range(25):
        edges = [(f"{q}-{rnd.randrange(14)}", f"{q}-{rnd.randrange(14)}", f"r{i}") for i in range(rnd.choice([0, 3, 12, 40]))]
        edges += edges[:1]
        start = [f"{q}-{rnd.randrange(14)}" for _ in range(rnd.choice([1, 1, 3]))]
        start = list(dict.fromkeys(start))
        seeds += [(q, i, s) for i, s in enumerate(start, 1)]
        rows += [(*e, len(rows) + i) for i, e in enumerate(edges)]
        expected[q] = fifo(start, edges)
    adjacent = graph.adjacency(spark.createDataFrame(rows, EDGES))
    got = {q: [] for q in expected}
    for r in graph.walk(spark.createDataFrame(seeds, "qid bigint, rank bigint, node string"), adjacent).orderBy("qid", "place").collect():
        got[r.qid].append((r.place, r.node, r.relation, r.depth))
    assert got == expected and any(len(x) > 8 for x in got.values())


def test_adjacency_drops_open_ends_and_names_relations(spark):
    df = spark.createDataFrame([("a", "b", None, 0), ("a", None, "x", 1), ("", "b", "x", 2), ("c", "c", "y", 3)], EDGES)
    assert sorted((r.node, r.neighbour, r.relation, r.adj_ord) for r in graph.adjacency(df).collect()) == [("a", "b", "关联", 0), ("b", "a", "关联", 1), ("c", "c", "y", 6), ("c", "c", "y", 7)]


def test_sense_against_all_pairs(spark):
    titles = ["River", "river bank", "a", "银行 卡", None, "", "BANK", "x y z", "é", "卡", "river", "the river bank"]
    texts = ["the River bank", "银行卡 a", "", None, "no", "x É", "卡"]
    nodes = spark.createDataFrame([(f"n{i}", t, None, i) for i, t in enumerate(titles)], NODES)
    df = spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")
    expected = {}
    for q, text in enumerate(texts):
        hits = []
        for i, t in enumerate(titles):
            title = (t or f"n{i}").lower()
            if text is not None:
                score = 0.8 if title in text.lower() else 0.5 if any(w in text.lower() for w in title.split() if len(w) > 1) else 0
                if score:
                    hits.append((-score, i))
        expected[q] = [(f"n{i}", -s) for s, i in sorted(hits)[:5]]
    got = {q: [] for q in expected}
    for r in graph.sense(df, nodes).orderBy("qid", "rank").collect():
        got[r.qid].append((r.node, r.score))
    assert got == expected


def test_spread_and_partition(spark):
    edges = spark.createDataFrame([("a", "b", "r", 0), ("b", "c", "r", 1), ("x", "y", "r", 2), ("z", "z", "r", 3)], EDGES)
    seeds = spark.createDataFrame([(0, "a", 1.0)], "qid bigint, node string, strength double")
    got = {r.node: r.strength for r in graph.spread(seeds, graph.adjacency(edges)).collect()}
    assert got == pytest.approx({"a": 1.125, "b": 0.5, "c": 0.125})
    parts = {r.node: (r.part, r.is_centre) for r in graph.partition(edges).collect()}
    assert parts == {"a": ("a", False), "b": ("a", True), "c": ("a", False), "x": ("x", True), "y": ("x", False), "z": ("z", True)}
    assert graph.partition(edges.limit(0)).collect() == []


def test_partition_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", "r", i) for i in range(200)], EDGES)
    assert {r.part for r in graph.partition(edges).collect()} == {"000"}


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (2, "x"), (3, "x"), (3, None)], "g int, i string")
    assert [(r.a, r.b, r.n) for r in graph.cooccurrence(df, "g", "i").collect()] == [("x", "y", 2)]


def test_index_files_in_both_languages(spark, tmp_path):
    forms = [
        {"节点": {"a": {"title": "A", "类型": "t"}, "b": {}}, "丝线": [{"源": "a", "目标": "b"}, {"源": "a"}]},
        {"nodes": [{"id": "a", "title": "A", "type": "t"}, {"title": "b"}], "edges": [{"from": "a", "to": "b", "relation": "关联"}, {"source": "", "target": "b"}]},
    ]
    for i, form in enumerate(forms):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(form, ensure_ascii=False), encoding="utf-8")
        nodes, edges = stores.read_graph(spark, str(path))
        assert [r.id for r in nodes.orderBy("ord").collect()] == ["a", "b"] and nodes.orderBy("ord").first().title == "A" and nodes.orderBy("ord").first().type == "t"
        assert [(r.src, r.dst, r.relation) for r in edges.collect()] == [("a", "b", "关联")]
    assert stores.read_graph(spark, str(tmp_path / "none.json"))[0].collect() == []


def test_prefetch(spark, memories):
    nodes = spark.createDataFrame([("n1", "river", None, 0), ("n2", "bridge", None, 1)], NODES)
    edges = spark.createDataFrame([("n1", "n2", "r", 0)], EDGES)
    rows = memories(*({"id": i, "owner": "me", "status": "active", "content": c} for i, c in enumerate(["the bridge", "a river", "river and bridge", "nothing", "plain words"], 1)))
    texts = spark.createDataFrame([(0, "by the river"), (1, "plain words"), (2, "zzz"), (3, None)], "qid bigint, text string")
    got = {}
    for r in recall.prefetch(texts, rows, nodes, graph.adjacency(edges), "me", Walk()).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert set(got) == {0, 1} and set(got[0]) == {1, 2, 3} and got[0][-1] == 1 and got[1] == [5]


def test_partition_does_not_end_before_its_parts_are_whole(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", None, i) for i in range(30)], "src string, dst string, relation string, ord bigint")
    assert {r.part for r in graph.partition(edges).collect()} == {"n00"}
    with pytest.raises(RuntimeError):
        graph.partition(edges, 1)
