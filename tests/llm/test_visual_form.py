"""The visual form against rules stated row by row."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from utterlake.llm.queries import p4_found
from utterlake.llm.visual_form import form_array, letters, letters_array, visual_form

SAME = [
    ("ｔｈｅ", "the"), ("ﺳﺎﻝ", "سال"), ("ﻻ", "لا"), ("é", "é"), ("آ", "آ"), ("ي ك ى", "ی ک ی"), ("а с", "a c"), ("Ζο", "Zo"), ("٠١٢٣٧٨٩", "۰۱۲۳۷۸۹"), ("a 　b ", " a b"),
    ("کو​چه", "کوچه"), ("در‌خت", "درخت"), ("س‍لام", "سلام"), ("trans­cript", "transcript"), ("می‌‌رود", "می‌رود"), ("x‌", "x"), ("ئ", "ئ"), ("ﬁn", "fin"),
    ("한", "한"), ("á̖", "á̖"), ("هٔ", "ۀ"), ("بَ‌ه", "بَ‌‌ه"), ("﻿b", "b"), ("！", "!"),
]
DIFFERENT = [("می‌رود", "میرود"), ("٤", "۴"), ("The", "the"), ("آ", "ا"), ("ؤ", "و"), ("کِتاب", "کتاب"), ("a.", "a"), ("،", ","), ("1", "۱"), ("ab", "a b"), ("²", "2"), ("کـتاب", "کتاب"), ("ب‌​ه", "به")]


def form(*texts):
    return form_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert form(a) != form(b)


def test_nulls_blanks_and_slices():
    assert form(None, "", " ​\t", "a") == [None, "", "", "a"]
    assert form_array(pa.array(["x", "ａ", None, "b"])[1:]).to_pylist() == ["a", None, "b"]
    assert form_array(pa.array([], pa.string())).to_pylist() == []


def test_rows_do_not_touch():
    texts = ["a", "́b", "ب‌", "ه", " ", "ᄒ", "ᅡ", "‌"]
    assert form(*texts) == [form(t)[0] for t in texts]


ALPHABET = "ab ｃé̖́آآي ىکﺳﻻ‌​‍٤۴٣　.،！한한ὰٔهحدﬁа"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), max_size=6))
def test_idempotent_and_independent_of_neighbours(texts):
    once = form(*texts)
    assert once == [form(t)[0] for t in texts]
    assert form(*once) == once
    assert letters_array(pa.array(texts, pa.string())).to_pylist() == [letters_array(pa.array([t], pa.string()))[0].as_py() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=0x20, max_codepoint=0x24F, exclude_categories=("Cf", "Cc", "Cs")), max_size=20))
def test_canonical_equivalents_are_equal(text):
    assert form(text) == form(unicodedata.normalize("NFD", text)) == form(unicodedata.normalize("NFC", text))


def test_letters():
    got = letters_array(pa.array(["ＡＢ-c 1 کـتِاب", None, "ﻻآ", "..."])).to_pylist()
    assert got == ["abcکتاب", None, "لاآ", ""]


def test_columns(spark):
    df = spark.createDataFrame([(1, "ａ"), (2, None)], "id int, text string")
    assert [tuple(r) for r in df.orderBy("id").select(visual_form("text"), letters("text")).collect()] == [("a", "a"), (None, None)]
    long = "سلام ﺳﺎﻝ " * 400_000
    assert spark.createDataFrame([(long,)], "t string").select(visual_form("t")).first()[0] == ("سلام سال " * 400_000).strip()


def test_query(spark, tmp_path):
    rows = [("a", "ي", "ی"), ("a", "ي", "ی"), ("b", "x", "x"), ("c", None, "x"), ("d", " ", "　"), ("e", "x", "y"), ("f", "​", "﻿")]
    spark.createDataFrame(rows, "id string, text string, sentence string").write.parquet(str(tmp_path / "utterances.parquet"))
    assert [r.id for r in p4_found(spark, str(tmp_path)).collect()] == ["a"]
