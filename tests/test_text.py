"""Normalisers and metrics against literal vectors and plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from utterlake.functions import metrics, text
from utterlake.operators.segments import edits


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column("t")).collect()]


def test_evaluation_form(spark):
    assert values(spark, text.normalize_eval, ["من ۱۲ سال دارم، 中国。", "language Persian<asr_text> a\tb ", None, "", "ﻻ كي"]) == ["من 12 سال دارم 中国", "a b", None, "", "لا کی"]


def test_standard_form(spark):
    got = values(spark, text.standardize, ["كتابة ۱۲!", "a\nb سلام", "أحمد، ؤ ى", "ﻐﻠ", None])
    assert got == ["کتابه", "سلام", "احمد و ی", "ل", None]


def test_ctc_form(spark):
    got = values(spark, text.normalize_ctc, ["language Persian<asr_text>كِتاب، A‌b", "ۀ ة ى", "ــ", None])
    assert got == ["کتاب a b", "ه ه ی", "", None]


def test_chunk_form(spark):
    assert values(spark, text.normalize_chunk, ["é،x‌y", "كۀ 12", None]) == ["،x y", "که 12", None]


def test_eval_form_equals_python(spark):
    rng = random.Random(5)
    pool = "abc ۱٢3 .,،؟‌يكی\t\n ﻻｆ－¼²𝟗x<"

    def plain(t):
        t = unicodedata.normalize("NFKC", re.sub(r"^language\s+[^<]+<asr_text>", "", t).strip()).translate(str.maketrans("يك", "یک")).replace("‌", " ")
        t = "".join(str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c for c in t)
        return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in t).split())

    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(300)]
    assert values(spark, text.normalize_eval, texts) == [plain(t) for t in texts]


def test_word_and_char_edits(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("ab سلام 中 d".split()) for _ in range(rng.randrange(7))), " ".join(rng.choice("ab سلام 中 e".split()) for _ in range(rng.randrange(7)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", metrics.word_edits("a", "b").alias("w"), metrics.char_edits("a", "b").alias("c"))
    for a, b, w, c in df.collect():
        assert w == edits(a.split(), b.split()) and c == edits(list(a), list(b))


def test_error_rates(spark):
    df = spark.createDataFrame([("a b", ""), ("x", "x y z")], "reference string, prediction string")
    r = metrics.error_rates(metrics.row_errors(df)).first()
    assert (r.word_errors, r.words, r.wer) == (4, 3, 4 / 3)
    none = metrics.error_rates(metrics.row_errors(df.limit(0))).first()
    assert none.wer is None and none.words == 0


def test_summary(spark):
    df = spark.createDataFrame([(None, 2.0, 1.0, False), ("x", 2.0, 1.0, False)], "error string, duration double, elapsed double, cached boolean")
    r = metrics.eval_summary(df).first()
    assert (r.samples, r.failures, r.real_time_factor) == (2, 1, 0.5)
    assert metrics.eval_summary(df.withColumn("cached", F.lit(True))).first().real_time_factor is None


@pytest.mark.parametrize(("value", "name"), [(" a b/c ", "a_b_c"), ("__", "recording"), ("علی-1", "علی-1")])
def test_safe_id(spark, value, name):
    assert values(spark, text.safe_id, [value]) == [name]


def test_ids_and_paths(spark):
    r = spark.range(1).select(
        text.padded_id(F.lit("s"), F.lit(7)), text.padded_id(F.lit("s"), F.lit(123456)), text.stem(F.lit("a/b/c.d.wav")), text.stem(F.lit(".hidden")), text.relocate(F.lit("a/b.wav"), "x/"),
        text.language_name(F.lit("zh-CN")), text.language_name(F.lit("xx")), text.pair_key(F.lit("Voice_ Ab-1")),
    ).first()
    assert tuple(r) == ("s_chunk_0007", "s_chunk_123456", "c.d", ".hidden", "x/b.wav", "Chinese", "xx", "ab1")
