import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.llm import encode, mixing, subjects

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no vocabulary files")
TEXTS = ["hello world's  end", "", None, "哈" * 900, "a" * 5000, "<|endoftext|> x", "👩🏽‍🚀 𝔘 ñ", " \n\t  ", "=" * 4000 + " end", "可以直接复用，hello", "hello world's  end"]


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("check", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(encode.load_merges(encode.TOKENIZERS))


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in encode.encoded(df).collect()}
    assert got == {**{i: reference(t or "") for i, t in enumerate(TEXTS)}, None: reference("x")}
    back = {r.doc_id: r.text for r in encode.decoded(encode.encoded(df)).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(TEXTS)}, None: "x"}
    assert encode.encoded(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5))
def test_any_text(encoder, reference, texts):
    assert encoder.encode(texts).to_pylist() == [reference(t) for t in texts]


def test_common_words_are_kept_when_rare_ones_are_forgotten(monkeypatch, reference):
    monkeypatch.setattr(encode, "KEPT_WORDS", 40)
    e, rnd = encode.Encoder(encode.load_merges(encode.TOKENIZERS)), random.Random(2)
    for _ in range(12):
        texts = [f"common words stay {rnd.random()} {rnd.choice('abcdef')}{rnd.randrange(99)}" for _ in range(2)]
        assert e.encode(texts).to_pylist() == [reference(t) for t in texts]
        assert len(e.index) <= 40 and {"common", " words", " stay"} <= set(e.index) and len(e.used) == len(e.index) == len(e.sizes[0])


def test_words_are_forgotten_before_they_fill_the_memory(monkeypatch, reference):
    monkeypatch.setattr(encode, "KEPT_WORDS", 3)
    monkeypatch.setattr(encode, "QUERY_ROWS", 50)
    e = encode.Encoder(encode.load_merges(encode.TOKENIZERS))
    for text in ("one two three four five", "six seven one", "eight nine ten"):
        assert e.encode([text]).to_pylist() == [reference(text)] and len(e.index) <= 5


def test_mixture(spark):
    rnd = random.Random(2)
    rows = []
    for source, n in (("big", 3000), ("small", 60), ("mid", 500), (None, 40), ("untold", 30)):
        rows += [(source, " ".join(rnd.choice(["word", "other", "third", "语料"]) for _ in range(rnd.randrange(5, 60)))) for _ in range(n)]
    rows += [("big", None), ("big", ""), rows[0]]
    docs = spark.createDataFrame([(i, t, s, 1) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string, times int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 4), ("mid", 0.3, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert got["gone"].reached_share == 0 and set(got) == {"big", "small", "mid", "gone"}
    for s, share in (("big", 0.5), ("small", 0.1), ("mid", 0.3)):
        assert got[s].reached_share == pytest.approx(share / 0.9, abs=0.004)
    most = {"big": 1, "small": 4, "mid": 2}
    picked = chosen.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and all(0 < r.times <= most[r.source] and r.n_tokens > 0 for r in picked)
    # whole epochs before a part of one: times of a source differ by one at most
    for s in most:
        times = [r.times for r in picked if r.source == s]
        assert max(times) - min(times) <= 1
    again = {(r.doc_id, r.times) for r in mixing.mixture(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.times) for r in picked}
    less = {r.source: r for r in mixing.mixture(docs, targets, total=900)[1].collect()}
    assert sum(r.selected_tokens for r in less.values()) == pytest.approx(900, rel=0.06)
    empty, report = mixing.mixture(docs.limit(0), targets)
    assert empty.collect() == [] and {r.reached_share for r in report.collect()} == {0.0}


def test_better_documents_are_drawn_first(spark):
    good, poor = "a fine text with many different words in it, truly", "!!!! ???? !!!! ???? !!!!"
    docs = spark.createDataFrame([(i, good if i % 2 else poor, "s") for i in range(400)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    picked = mixing.mixture(docs, targets, total=1000)[0].collect()
    assert sum(r.doc_id % 2 for r in picked) > 0.8 * len(picked)


AREAS = {"law": ["court", "appeal", "witness", "notary", "plaintiff", "被告", "合议庭", "诉讼"], "music": ["piano", "choir", "solo", "tempo", "sonata", "钢琴", "和弦", "合唱"]}


def corpus(seed: int, n: int):
    rnd = random.Random(seed)
    talk = ["The {} comes first and only then the {}.", "Nobody expected the {} or the {}.", "没想到{}比{}还难。"]
    idle = ["Write the summary into memory.", "No new conclusion in this round.", "下次醒来先读这份摘要。", "The heat of this entry sank."]
    trap = ["It felt a bit like a {}, yet it was only the banner.", "书名里有“{}”两个字，与内容无关。"]
    out = []
    for i in range(n):
        own = rnd.sample(sorted(AREAS), rnd.choice([0, 1, 1, 2]))
        lines = [rnd.choice(talk).format(rnd.choice(AREAS[a]), rnd.choice(AREAS[a])) for a in own for _ in range(rnd.randrange(3, 6))]
        lines += [rnd.choice(idle) for _ in range(rnd.randrange(3, 8))]
        lines += [rnd.choice(trap).format(rnd.choice(AREAS[rnd.choice(sorted(AREAS))])) for _ in range(rnd.randrange(0, 3))]
        rnd.shuffle(lines)
        out.append((i, " ".join(lines), set(own)))
    return out


def test_areas_on_held_out_documents(spark):
    rows = corpus(1, 500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "\n" * 50_000, "x"), (None, rows[0][1], "x")], "doc_id bigint, text string, area string")
    labels = spark.createDataFrame([(i, a.upper() + " ", "z") for i, _, own in rows[:300] for a in (own or {"none"})] + [(1, "odd", "z"), (None, "law", "z"), (2, None, "z"), (77777, "law", "z")], "doc_id bigint, area string, text string")
    areas = spark.createDataFrame([("law",), ("music",), (None,)], "area string")
    got = [(r.doc_id, r.area) for r in subjects.subjects(docs, labels, areas).collect()]
    held = {(i, a) for i, _, own in rows[300:] for a in own}
    found = {x for x in got if x[0] is not None and 300 <= x[0] < 9000}
    assert len(held & found) >= 0.93 * len(held) and len(found - held) <= 0.05 * len(held)
    assert not {9001, 9002, 9003} & {i for i, _ in got}
    assert {r.area for r in subjects.composition(subjects.subjects(docs, labels, areas)).collect()} == {"law", "music"}
    assert subjects.subjects(docs.limit(0), labels, areas).collect() == [] and subjects.subjects(docs, labels.limit(0), areas).collect() == []


def test_sentences_and_lines():
    doc, row, term = subjects.sentence_terms(["One two. Three 1.5 four!\n- five\n1. six", None, "", "！！", "七八。"])
    assert doc.tolist() == [0, 0, 0, 0, 4] and len(set(row.tolist())) == 5 and len(term) == len(row)
