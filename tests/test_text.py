from pyspark.sql import functions as F

from tidepool.config import STOP_WORDS
from tidepool.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, "Ab_1 你好 x-Y", T.tokens) == ["ab_1", "x", "y", "你", "好"]
    assert one(spark, "", T.tokens) == [] and one(spark, None, T.tokens) == []


def test_normalised_drops_double_quotes_and_any_space_but_keeps_single_ones(spark):
    assert one(spark, "a b　\"c'，。(d)", T.normalised) == "abc'd"


def test_bigrams_of_short_and_long_texts(spark):
    assert [one(spark, x, T.char_bigrams) for x in ("", "a", "ab", "aba b", "😀a😀")] == [[], [], ["ab"], ["ab", "ba"], ["😀a", "a😀"]]
    assert one(spark, "x" * 200_000, T.char_bigrams) == ["xx"]
    assert [len(one(spark, x, T.bigram_codes)) for x in ("", "a", "aba b", "😀a😀")] == [0, 0, 2, 2]


def test_token_bigrams(spark):
    assert one(spark, "a b a b", lambda c: T.token_bigrams(T.tokens(c))) == ["a_b", "b_a"]
    assert one(spark, "a", lambda c: T.token_bigrams(T.tokens(c))) == []


def test_overlap(spark):
    rate = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(T.overlap_rate(F.col("a"), F.col("b")).alias("x")).first().x
    assert rate(["a", "b"], ["a"]) == 1.0 and rate([], ["a"]) == 0.0


def test_estimate_and_concepts(spark):
    assert one(spark, "你好 two words", T.token_estimate) == 4 and one(spark, None, T.token_estimate) == 0
    assert one(spark, "怎么 编译器 abc ab 编译器编译器编", lambda c: T.concepts(c, STOP_WORDS)) == ["编译器", "abc", "编译器编译器"]


def test_tags_text(spark):
    assert [one(spark, x, T.tags_text) for x in ('["a", "b"]', '["a", null]', "['a']", "a;b", None, "")] == ["a,b", "a", "['a']", "a;b", "", ""]


def test_event_time(spark):
    now = F.lit("2026-03-01 10:00:00").cast("timestamp_ntz")
    cases = {
        "昨天": "2026-02-28 10:00:00", "前天": "2026-02-27 10:00:00", "前天和昨天": "2026-02-28 10:00:00", "2月31日": "2026-02-31 00:00:00",
        "on 2025-01-02": "2025-01-02 00:00:00", "12月5日 2025-01-02": "2026-12-05 00:00:00", "none": "", None: "",
    }
    assert {k: one(spark, k, lambda c: T.event_time(c, now)) for k in cases} == cases


def test_strip(spark):
    assert one(spark, "　 a b\n", T.strip) == "a b"
