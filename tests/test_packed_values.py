import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tunefold.operators.packed_values import split_packed, tokenize_packed


@pytest.mark.parametrize(
    ("field", "values"),
    [
        (None, []),
        ("  ", []),
        (",;|", []),
        ("a,b", ["a", "b"]),
        (" a ; b|c/d、e，f\tg\nh·i；j｜k ", list("abcdefghijk")),
        ("hip hop, drum & bass", ["hip hop", "drum & bass"]),
        ('"7"" edit", post-rock', ['7" edit', "post-rock"]),
        ('"古风，国风";"rock/pop"|影视原声/rainy day;;', ["古风，国风", "rock/pop", "影视原声", "rainy day"]),
        ('["a, b", "c\\"d", "e"]  ', ["a, b", 'c"d', "e"]),
        ("['rock/pop', \"rock'n'roll\", '90s']", ["rock/pop", "rock'n'roll", "90s"]),
        ('["\\u00e9t\\u00e9"]', ["été"]),
        ("no. 1\\, live,\\#1 hits", ["no. 1, live", "#1 hits"]),
        ("#R&B #hip hop", ["R&B", "hip hop"]),
        ("#soul#demo", ["soul", "demo"]),
        ('"#1 hits"|K-Pop', ["#1 hits", "K-Pop"]),
        ("90's、rock'n'roll", ["90's", "rock'n'roll"]),
        ('"open, a', ['"open', "a"]),
        ("a,a,a", ["a", "a", "a"]),
        ("[[1, 2], [3]]", ["1", "2", "3"]),
        ("f(x), g", ["f(x)", "g"]),
        ('""', []),
    ],
)
def test_fields(field, values):
    assert tokenize_packed(field) == values


VALUE = st.text(st.characters(codec="utf-8", exclude_categories=("Cc", "Cs", "Zs", "Zl", "Zp", "Cf")), min_size=1, max_size=8)


@given(st.lists(VALUE.filter(lambda v: v.strip() == v and "\\" not in v), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_json_round_trip(values):
    assert tokenize_packed(json.dumps(values, ensure_ascii=False)) == values


@given(st.lists(VALUE.filter(lambda v: v.strip() == v and "\\" not in v), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_csv_round_trip(values):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(values)
    assert tokenize_packed(out.getvalue()) == values


def test_long_field():
    assert len(tokenize_packed(",".join(["x"] * 50_000))) == 50_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "a,b", "p"), (1, "a,b", "q"), (2, None, "r"), (3, "", None)], "row_id long, tags string, tag string")
    got = sorted(tuple(r) for r in split_packed(df, "tags", ["row_id"], "tag_pos", "tag").collect())
    assert got == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    assert split_packed(df.limit(0), "tags", ["row_id"]).count() == 0


def test_own_delimiters(spark):
    from tunefold.operators.packed_values import split_packed

    df = spark.createDataFrame([(1, "a~b,c~ d"), (2, None)], "k long, f string")
    got = [(r["pos"], r["value"]) for r in split_packed(df, "f", ["k"], delimiters="~").orderBy("pos").collect()]
    assert got == [(0, "a"), (1, "b,c"), (2, "d")]
