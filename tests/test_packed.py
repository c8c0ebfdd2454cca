import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepool.functions import packed
from tidepool.functions.packed import split_labels
from tidepool.operators.unpack import unpack_values

CASES = {
    None: [], "": [], "  ": [], "[]": [], '[""]': [], "教训": ["教训"], "a,b": ["a", "b"], "a, ,b": ["a", "b"],
    '["影像", null]': ["影像"], "['I/O', '归档']": ["I/O", "归档"], '["say \\"hi\\"", "\\u6559\\u8bad"]': ['say "hi"', "教训"],
    '"say ""hi"""|a': ['say "hi"', "a"], "“x,y，z”、“c”": ["x,y，z", "c"], "【R&D】【x y】": ["R&D", "x y"], "#long task  #x#y": ["long task", "x", "y"],
    "a / b/c": ["a", "b/c"], "CI/CD; 经验 、x|y": ["CI/CD", "经验", "x", "y"], "C++\tv1.2\non_call": ["C++", "v1.2", "on_call"],
    '是"否': ["是", "否"], '「a,b」"c;d"': ["a,b", "c;d"], "a  b": ["a", "b"], '"x,y,z"': ["x,y,z"], "null": ["null"], '[null, "null"]': ["null"],
}


@pytest.mark.parametrize("field", CASES)
def test_cases(field):
    assert split_labels(pa.array([field], pa.string()))[0].as_py() == CASES[field]
    if field:
        assert packed._scan(field) == CASES[field]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab教 ,;/|"\'[]「」“”#\\·-', max_size=12), max_size=6))
def test_batches_agree_with_single_rows(fields):
    together = split_labels(pa.array(fields, pa.string())).to_pylist()
    assert together == [split_labels(pa.array([x], pa.string()))[0].as_py() for x in fields]
    assert all(x and x == x.strip() for labels in together for x in labels)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab教 ,;/|#·-+.\t、", max_size=14))
def test_mask_and_scanner_have_the_same_rules(field):
    assert split_labels(pa.array([field]))[0].as_py() == packed._scan(field)


def test_rows_positions_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a,b", "x"), (1, "a,b", "y"), (2, None, "z"), (None, "c" * 100_000 + ";d", "z")], "id bigint, tags string, tag string")
    got = sorted((r.id or 0, r.pos, len(r.tag)) for r in unpack_values(df, "id", "tags").collect())
    assert got == [(0, 1, 100_000), (0, 2, 1), (1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]
    assert unpack_values(df.limit(0), "id", "tags").collect() == []
