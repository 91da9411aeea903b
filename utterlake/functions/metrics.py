"""Edit distances and error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, normalize_ctc, normalize_eval, plain_text, words


def coded(tokens: Column, table: Column) -> Column:
    """Tokens as one code point each: their place in a table of distinct tokens, past the surrogates where it would be one."""
    place = lambda t: F.array_position(table, t) + F.lit(255)
    number = lambda t: place(t) + F.when(place(t) >= 0xD800, 0x800).otherwise(0)
    point = lambda t: F.decode(F.unhex(F.lpad(F.hex(number(t)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(tokens, point), "")


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens, of fewer than a million distinct tokens together."""
    table = F.array_distinct(F.concat(a, b))
    return F.levenshtein(coded(a, table), coded(b, table))


def word_edits(reference: Column | str, hypothesis: Column | str) -> Column:
    return token_edits(words(reference), words(hypothesis))


def char_edits(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance in code points, blanks counted."""
    return F.levenshtein(col(reference), col(hypothesis))


def row_errors(df: DataFrame, reference: str = "reference", prediction: str = "prediction", form: str = "raw") -> DataFrame:
    """Add word_errors, words, char_errors and chars of each row in one form: raw, normalized or ctc."""
    clean = {"raw": plain_text, "normalized": normalize_eval, "ctc": normalize_ctc}[form]
    ready = df.withColumns({"_r": F.coalesce(clean(reference), F.lit("")), "_h": F.coalesce(clean(prediction), F.lit(""))})
    return ready.withColumns({
        "word_errors": word_edits("_r", "_h").cast("bigint"), "words": F.size(words("_r")).cast("bigint"),
        "char_errors": char_edits("_r", "_h").cast("bigint"), "chars": F.length("_r").cast("bigint"),
    }).drop("_r", "_h")


def error_rates(errors: DataFrame, *by: str) -> DataFrame:
    """Corpus error rates from row_errors: sums of errors over sums of reference units, null where there are none."""
    sums = errors.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("word_errors", "words", "char_errors", "chars")])
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return sums.withColumns({"wer": rate("word_errors", "words"), "cer": rate("char_errors", "chars")})


def eval_summary(predictions: DataFrame, *by: str) -> DataFrame:
    """Samples, failures and real-time factor; the factor is null if a prediction was cached or no audio was heard.

    predictions: error string, duration, elapsed double, cached boolean.
    """
    return predictions.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.count_if(F.col("cached")).alias("reused_predictions"),
        F.when(~F.coalesce(F.bool_or("cached"), F.lit(False)), F.try_divide(F.sum("elapsed"), F.sum("duration"))).alias("real_time_factor"),
    )


def result_table(metrics: DataFrame, id_column: str) -> DataFrame:
    """Wide rates of raw and normalized form as a long table: id, form, wer, cer."""
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"{f}_wer").alias("wer"), F.col(f"{f}_cer").alias("cer")) for f in ("raw", "normalized")])
    return metrics.select(id_column, F.explode(forms).alias("x")).select(id_column, "x.form", "x.wer", "x.cer")
