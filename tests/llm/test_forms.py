import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.llm import alike
from tidepool.llm.canonical import compile_table, transducer
from tidepool.llm.queries import p5_forms, p5_found

SAME = [
    ("hello 1", "ｈｅｌｌｏ　１"), ("é", "é"), ("ü", "ü"), ("ガ", "ｶﾞ"), ("パ", "パ"), ("abc", "a​b﻿c­"), ("a b", "a b"), ("a b", "a b"), ("paypal", "раураl"),
    ("é", "е́"), ("é", "e‍́"), ("ἄ", "ἄ"), ("Å", "Å"), ("각", "각"), ("ABEKMHOPCTX", "АВЕКМНОРСТХ"), ("!", "！"), ("a\tb", "a b"), ("é\tb", "é b"),
]
APART = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("x2", "x²"), ("1", "①"), ("，", "、"), ("ß", "ss"), ("a\t\tb", "a b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_alike(a, b):
    assert transducer().form(a) == transducer().form(b)


@pytest.mark.parametrize(("a", "b"), APART)
def test_visible_differences_stay(a, b):
    assert transducer().form(a) != transducer().form(b)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("aeо́̈​ ｶﾞｅА")), max_size=20))
def test_form_of_a_form_is_the_form(text):
    form = transducer().form(text)
    assert transducer().form(form) == form and unicodedata.is_normalized("NFC", form)


def test_table_has_no_chains():
    table = compile_table()[0]
    assert all(table.get(x, x) == x for form in table.values() for x in form)


def test_core():
    assert transducer().core("Ａ-b　C_é①，你好！") == "abcé①你好"


def test_pairs_against_all_pairs(spark):
    texts = ["hi there", "ｈｉ there", "hi there", "hi there", None, "", "​", "ok", "ok", "оk", "x" * 50_000, "x" * 50_000 + "﻿"]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "id bigint, content string, text string, f1 int")
    form = transducer().form
    expected = {("m", i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and form(a) == form(b)}
    got = [tuple(r) for r in alike.alike_pairs(("m", df, "id", "content")).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert alike.alike_pairs(("m", df.limit(0), "id", "content"), ("g", df.limit(0), "id", "content")).collect() == []


def test_short_memories_are_in_no_pair_but_short_contexts_are(spark, tmp_path):
    texts = ["ok, noted", "ｏk, noted", "eleven char", "ｅleven char", "twelve chars x", "ｔwelve chars x", None, ""]
    assert [len(transducer().core(x)) for x in texts[2:6:2]] == [10, 12]
    spark.createDataFrame(list(enumerate(texts)), "id bigint, content string").write.parquet(f"{tmp_path}/memories.parquet")
    spark.createDataFrame(list(enumerate(texts)), "gold_id bigint, context string").write.parquet(f"{tmp_path}/gold.parquet")
    got = sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect())
    assert got == [("gold", 0, 1), ("gold", 2, 3), ("gold", 4, 5), ("memories", 4, 5)]


def test_consistent_column(spark):
    df = spark.createDataFrame([("ａ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(alike.consistent("t")).collect()] == ["a", None, ""]


def test_tabs_are_kept_apart_from_blanks(spark, tmp_path):
    texts = ["one\ttwo three four", "one two three four", "ｏne two\u2003three four", "ｏne\ttwo three\u2003four", "e\u0301\t\u0301x ёlement of ｗidth", "é\t\u0301x ёlement of width"]
    spark.createDataFrame(list(enumerate(texts)), "id bigint, content string").write.parquet(f"{tmp_path}/memories.parquet")
    spark.createDataFrame(list(enumerate(texts)), "gold_id bigint, context string").write.parquet(f"{tmp_path}/gold.parquet")
    got = sorted(tuple(r) for r in p5_found(spark, str(tmp_path)).collect())
    assert got == [(src, a, b) for src in ("gold", "memories") for a, b in ((0, 3), (1, 2), (4, 5))]
    forms = {r.id: r.form for r in p5_forms(spark, str(tmp_path)).where("src = 'memories'").collect()}
    assert forms[0] == forms[3] == texts[0] and forms[1] == forms[2] == texts[1] and forms[4] == forms[5]
    assert all(transducer().shown(x) == x for x in forms.values())
