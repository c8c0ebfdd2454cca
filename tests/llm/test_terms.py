import math
from collections import Counter

import pytest

from tidepool.llm import distinctive


def test_scores_against_formula(spark):
    texts = ["Apple apple APPLE pear", "pear plum_1 12345 ab", None, "", "你好 pear pear", "apple", "apple"]
    df = spark.createDataFrame([(str(i % 6), t, "c", 5) for i, t in enumerate(texts)], "id string, content string, term string, df int")
    docs = [Counter(distinctive.terms_of(t or "")) for t in texts]
    cf, n_docs = sum(docs, Counter()), Counter(w for d in docs for w in d)
    total = cf.total()
    expected = {}
    for i, d in enumerate(docs):
        for w, tf in d.items():
            if n_docs[w] >= 2:
                c = cf[w] / total
                p = (tf + 50 * c) / (d.total() + 50)
                expected.setdefault((str(i % 6), w), []).append((tf, n_docs[w], p * math.log(p / c)))
    got = {}
    for r in distinctive.term_scores(df, "id", "content").collect():
        got.setdefault((r.rec_key, r.term), []).append((r.tf, r.df, r.score))
    assert set(got) == set(expected)
    for k, rows in expected.items():
        for a, b in zip(sorted(rows), sorted(got[k]), strict=True):
            assert a == pytest.approx(b)
    assert distinctive.term_scores(df.limit(0), "id", "content").collect() == []


def test_a_rare_shared_term_counts_more_than_a_common_one(spark):
    rows = [(i, "common words here") for i in range(30)] + [(90, "common common rare rare"), (91, "rare common")]
    got = {r.term: r.score for r in distinctive.term_scores(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").where("rec_key = '90'").collect()}
    assert got["rare"] > got["common"]


def test_limits_and_long_text(spark):
    rows = [(1, "zeta zeta zeta"), (2, "zeta"), (3, "solo solo solo"), (4, "word " * 200_000)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert [(r.rec_key, r.term, r.tf) for r in distinctive.term_scores(df, "id", "t", least_tf=3, most_df=6).collect()] == [("1", "zeta", 3)]
    assert {r.tf for r in distinctive.term_scores(df, "id", "t", least_df=1).where("term = 'word'").collect()} == {200_000}
