import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from data import SCHEMA, WORDS, cores, linked, memories, sentence

from tidepool.functions.packed import split_labels
from tidepool.llm import copies, forest, neardup, sketch
from tidepool.llm.components import components


def groups(pairs):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {(top(x), x) for x in list(parent) if top(x) != x}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = memories(seed)
    expected = groups(linked(rows))
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and len(set(got) & expected) >= 0.99 * len(expected) and len(set(got) - expected) <= 0.01 * len(expected)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(df).collect() == [] and copies.copies(df).collect() == [] and copies.collapsed(df).collect() == []


def test_a_hot_group_of_copies_and_of_small_edits(spark):
    base = sentence(random.Random(3), 14)
    rows = [(i, "hot", base, None, None, *[None] * 4) for i in range(2000)] + [(2000 + i, "hot", base + f" {i}号", None, None, *[None] * 4) for i in range(500)]
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, i) for i in range(1, 2500)}


def test_an_owner_of_many_alike_templates(spark):
    base = sentence(random.Random(3), 14)
    rows = [(i, "hot", base + f" {i}号", None, None, *[None] * 4) for i in range(4_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert neardup.near_duplicates(df).agg({"id_a": "max", "id_b": "count"}).first() == (0, 3_999)


def test_bucket_output_is_linear():
    n, w = 5000, 8
    run = neardup.bucket_neighbours(128, w)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), pa.array(np.arange(a, b)), *[pa.array(np.zeros(b - a, np.int64))] * 2], names=["key", "id", "s1", "s2"])
    pairs = {(a, b) for out in run(iter([batch(0, 1700), batch(1700, 1701), batch(1701, n)])) for a, b in zip(out[0].to_pylist(), out[1].to_pylist(), strict=True)}
    assert {p for p in pairs if p[0] != p[1]} == {(i - d, i) for i in range(n) for d in range(1, w + 1) if i >= d} | {(0, i) for i in range(1, n)}
    assert {a for a, b in pairs if a == b} == set(range(w, n))


def test_bucket_reaches_past_members_that_are_not_alike():
    rnd = np.random.default_rng(1)
    n = 900
    s1, s2 = rnd.integers(-(2**63), 2**63, n), rnd.integers(-(2**63), 2**63, n)
    s1[-1], s2[-1] = s1[5], s2[5]
    parts = [pa.RecordBatch.from_arrays([pa.array(np.ones(b - a, np.int32)), pa.array(np.arange(a, b)), pa.array(s1[a:b]), pa.array(s2[a:b])], names=["key", "id", "s1", "s2"]) for a, b in ((0, 400), (400, 401), (401, n))]
    pairs = {(a, b) for out in neardup.bucket_neighbours(20)(iter(parts)) for a, b in zip(out[0].to_pylist(), out[1].to_pylist(), strict=True)}
    assert pairs == {(5, n - 1)}


def test_the_rest_of_large_buckets_is_compared(spark, monkeypatch):
    rows = memories(5)
    expected = groups(linked(rows))
    monkeypatch.setattr(neardup.bucket_neighbours, "__defaults__", (1, 1))
    got = {tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & expected) >= 0.99 * len(expected) and len(got - expected) <= 0.01 * len(expected)


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_rest_skips_the_largest_group(spark, chunk):
    rows = [(k, i, g, 0, 0) for k, ids in ((1, (0, 1)), (2, (2, 3, 4)), (3, (5,)), (4, (0, 3))) for i, g in zip(ids, [(7, 7, 7, 3, 4, 4)[i] for i in ids], strict=True)]
    named = spark.createDataFrame(rows, "key int, id bigint, group bigint, s1 bigint, s2 bigint")
    got = {tuple(r) for r in neardup.split_buckets(named, chunk).mapInArrow(neardup.rest_of_buckets(0), "a bigint, b bigint").collect()}
    assert got == {(2, 3), (2, 4), (3, 4), (0, 3)}


def test_signatures_estimate_likeness():
    rnd = random.Random(4)
    texts = [sentence(rnd, 14).replace(" ", "").replace("，", "") for _ in range(30)]
    texts += [t[len(t) // 5 :] for t in texts]
    s = sketch.signatures(texts)
    gap = [(s[i] == s[j]).mean() - sketch.likeness_of(texts[i], texts[j]) for i in range(60) for j in range(i)]
    assert abs(np.mean(gap)) < 0.01 and np.std(gap) < 0.05
    whole = sketch.signatures(["".join(texts) * 3])
    assert (whole == np.minimum.reduce(s)).mean() > 0.9


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {(r.v, r.u) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_hidden_copies_against_all_rows(spark):
    rows = memories(7)
    known, members = cores(rows), defaultdict(list)
    for r in rows:
        if r[0] in known:
            members[(*known[r[0]], frozenset(x.lower() for x in split_labels(pa.array([r[3]], pa.string()))[0].as_py()))].append(r[0])
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in copies.copies(df).collect()]
    expected = {(min(v), x) for v in members.values() for x in v if x != min(v)}
    assert set(got) == expected and len(got) == len(expected) > 0
    assert sorted((r.id, r.copies) for r in copies.collapsed(df).collect()) == sorted((min(v), len(v)) for v in members.values())


BATCHES = [(0, "2026-01-01", "2026-01-13"), (1, "2026-01-13", "2026-01-16"), (2, "2026-01-16", "2026-01-21"), (3, "2026-01-21", "2026-02-01")]


def sequential(rows):
    """The cases by taking the memories one after the other."""
    known, links, seen = cores(rows), defaultdict(set), {}
    for a, b in linked(rows):
        links[a].add(b)
        links[b].add(a)
    for r in rows:
        if r[0] is None:
            continue
        t = (r[4] or "").replace("/", "-").replace("T", " ")
        for no, a, b in BATCHES:
            if a <= t[:10] < b:
                seen[r[0]] = (no, t, r[0])
    accepted, cases = set(), set()
    for no, _, i in sorted(seen.values()):
        if i in known and no and links[i] & accepted:
            cases.add((no, i))
        elif i in known:
            accepted.add(i)
    return cases


def batches(spark):
    return spark.createDataFrame([(n, f"{a} 00:00:00", f"{b} 00:00:00") for n, a, b in BATCHES], "batch_no int, opened_at string, closed_at string").selectExpr("batch_no", "cast(opened_at as timestamp_ntz) opened_at", "cast(closed_at as timestamp_ntz) closed_at")


SMALL = {"FAN": 2, "PART_ROWS": 40, "PART_CORES": 30, "GROUP_BYTES": 2000, "FIRST": 1, "ONE_TASK": 0}


@pytest.mark.parametrize(("seed", "small"), [(1, {}), (9, SMALL)])
def test_batches_against_one_after_the_other(spark, tmp_path, monkeypatch, seed, small):
    for name, value in small.items():
        monkeypatch.setattr(forest, name, value)
    rows = memories(seed)
    expected, folder = sequential(rows), f"file://{tmp_path}/forest"
    got = [tuple(r) for r in forest.repeated_memories(spark.createDataFrame(rows, SCHEMA), batches(spark), folder).collect()]
    assert len(got) == len(set(got)) and len(expected) > 20
    assert len(set(got) ^ expected) <= 0.02 * len(expected)
    # the folder is the state: opened again, it knows what was accepted, and nothing of that is new
    again = forest.HashForest(spark, folder)
    assert len(again.runs) == (len({r.level for r in again.runs}) if small else 4)
    texts = [(r[2], 10_000 + i, 1, r[1]) for i, r in enumerate(rows) if r[0] is not None and r[4] is not None and r[4][:10].replace("/", "-") < "2026-01-13"][:50]
    counted = {t[1] for t in texts if t[0] is not None and t[3] is not None and len(forest.sketch.transducer().core(t[0])) >= forest.sketch.MIN_CORE}
    assert {r.id for r in again.ingest(spark.createDataFrame(texts, "text string, id bigint, at bigint, owner string"), keep=False).collect()} == counted


def test_a_batch_reads_what_its_prefixes_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "GROUP_BYTES", 4000)
    rnd = random.Random(8)
    rows = [(sentence(rnd, 5), i, i, f"o{i % 7}") for i in range(6000)]
    tree = forest.HashForest(spark, f"file://{tmp_path}/forest")
    kind = "text string, id bigint, at bigint, owner string"
    tree.append(forest.first_of_class(forest.sketched(spark.createDataFrame(rows, kind))), 6000)
    own = [(rows[5][0] + "!", 9000, 9000, "o5"), (rows[5][0] + "?", 9001, 9001, "o6"), (rows[6][0].replace(rows[6][0].split("，")[0], "x"), 9002, 9002, "o6")]
    assert {r.id for r in tree.ingest(spark.createDataFrame(own, kind), keep=False).collect()} == {9000, 9002}
    one = tree.bytes_read
    assert tree.ingest(spark.createDataFrame([(sentence(rnd, 5), 9003, 1, "nobody")], kind), keep=False).collect() == [] and 0 <= tree.bytes_read < one
    assert one < 6000 * forest.TREES * 32 / 10


def test_an_empty_batch_and_an_empty_history(spark, tmp_path):
    tree = forest.HashForest(spark, f"file://{tmp_path}/forest")
    kind = "text string, id bigint, at bigint, owner string"
    assert tree.ingest(spark.createDataFrame([(None, 1, 1, "a"), ("", 2, 1, "a"), ("short", 3, 1, "a")], kind)).collect() == [] and tree.runs == []
    assert [r.id for r in tree.ingest(spark.createDataFrame([("one long enough text", 5, 2, "a"), ("One long enough text.", 6, 2, "a")], kind)).collect()] == [6]
    assert [r.rows for r in tree.runs] == [1]


def test_resolving_in_one_task():
    links = pa.RecordBatch.from_arrays([pa.array([2, 3, 3, 4, 9]), pa.array([1, 2, 1, 3, 4])], names=["a", "b"])
    assert [b[0].to_pylist() for b in forest._resolved(iter([links]))] == [[2, 3, 9]]
    assert [b[0].to_pylist() for b in forest._resolved(iter([]))] == [[]]


def test_entries_whose_links_fall_away_are_searched_whole(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    base, rows = sentence(rnd, 8).split("，"), []
    for i in range(200):
        clauses = list(base)
        for _ in range(rnd.randrange(4)):
            clauses[rnd.randrange(8)] = f"{rnd.choice(WORDS)} {rnd.choice(WORDS)}{rnd.randrange(1000)}"
        rows.append(("，".join(clauses), i, i, "hot"))
    df = spark.createDataFrame(rows, "text string, id bigint, at bigint, owner string")
    found = lambda name: {r.id for r in forest.HashForest(spark, f"file://{tmp_path}/{name}").ingest(df, keep=False).collect()}
    usual = found("a")
    monkeypatch.setattr(forest, "FIRST", 10**6)
    assert usual == found("b")


def test_pairs_told_apart_without_their_runs_are_not_alike():
    rnd = random.Random(4)
    texts = [sentence(rnd, n) for n in (1, 3, 8, 12) for _ in range(15)] + ["", "ab", "abc", "ab" * 300]
    texts = [sketch.transducer().core(x) for x in texts + [x[: len(x) * 4 // 5] for x in texts] + [x[9:] + x[:5] for x in texts]] + ["".join(chr(0x4E00 + rnd.randrange(9000)) for _ in range(50_000))]
    i, j = (x.ravel() for x in np.indices((len(texts),) * 2))
    kept = sketch._may_be_alike(texts, i, j, 0.6)
    alike = np.array([sketch.likeness_of(texts[a], texts[b]) >= 0.6 for a, b in zip(i, j, strict=True)])
    assert alike.sum() > len(texts) and kept[alike].all()
    assert kept.sum() < 1.2 * alike.sum()


def test_a_candidate_is_verified_once_and_by_tasks_for_the_number_of_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forest, "FIRST", 1)
    monkeypatch.setattr(forest, "GROWTH", 4)
    monkeypatch.setattr(forest, "PAIRS", 20)
    asked, parts, verified = [], [], sketch.verified

    def told(pairs, *more):
        asked.append([(r.a, r.b) for r in pairs.collect()])
        parts.append(pairs.rdd.getNumPartitions())
        return verified(pairs, *more)

    monkeypatch.setattr(sketch, "verified", told)
    rnd = random.Random(5)
    base = sentence(rnd, 12).split("，")
    # texts that share about half of their clauses pass the sketches in number, and few are duplicates
    rows = [("，".join([*base[:7], sentence(rnd, 5)]), i, i, "o") for i in range(120)]
    df = spark.createDataFrame(rows, "text string, id bigint, at bigint, owner string")
    found = {r.id for r in forest.HashForest(spark, f"file://{tmp_path}/forest").ingest(df, keep=False).collect()}
    pairs = [x for xs in asked for x in xs]
    assert len(asked) > 1 and len(pairs) > 100 and len(pairs) == len(set(pairs))
    assert all(n > len(xs) // 20 for n, xs in zip(parts, asked, strict=True))
    accepted, expected = [], set()
    for text, i, _, _ in rows:
        core = sketch.transducer().core(text)
        if any(sketch.likeness_of(core, x) >= 0.6 for x in accepted):
            expected.add(i)
        else:
            accepted.append(core)
    assert found <= expected and len(expected - found) <= 0.05 * len(expected)


def test_times_in_any_form_and_session_zone(spark):
    forms = {"2026-03-29 02:30:00": 0, "2026/03/29 02:30:00": 0, "2026-03-29T02:30:00.250": 250_000, " 2026-03-29 02:30:00 ": 0, "yesterday": None, "": None, None: None, "2026-13-01 00:00:00": None}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # where that hour is skipped
        df = spark.createDataFrame([(x,) for x in forms], "t string")
        got = {r.t: r.m for r in df.select("t", forest.parsed_time(df.t).alias("m")).collect()}
        start = 1_774_751_400_000_000
        assert got == {k: None if v is None else start + v for k, v in forms.items()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_history_and_no_batches(spark, tmp_path):
    df = spark.createDataFrame(memories(2)[:40], SCHEMA)
    assert forest.repeated_memories(df.limit(0), batches(spark), f"file://{tmp_path}/a").collect() == []
    assert forest.repeated_memories(df, batches(spark).where("batch_no = 0"), f"file://{tmp_path}/b").collect() == []
    later = batches(spark).selectExpr("batch_no + 1 as batch_no", "opened_at", "closed_at")
    assert forest.repeated_memories(df, later, f"file://{tmp_path}/c").count() > 0


def test_depth_meets_recall():
    assert forest.least_depth(0.6, 0.97) == 2 and forest.least_depth(0.6, 0.9) == 2 and forest.least_depth(0.9, 0.97) == 3 and forest.least_depth(0.6, 0.9999) == 1
