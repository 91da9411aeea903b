"""Text normalisers and string helpers as column expressions.

The five normalisers are different policies on purpose; their scores are not comparable.  All are native
expressions but for the NFKC step, which Spark lacks.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ZWNJ = "‌"
#: All that Python's str.split() takes for a blank.
BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"
# Punctuation that is in category P of newer Unicode than the JVM's.
NEW_PUNCTUATION = "؝᭽᭾⹓⹔⹕⹖⹗⹘⹙⹚⹛⹜⹝"
# Letters that the standard form keeps, and the punctuation it turns into blanks.
STANDARD_LETTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیئآ"
STANDARD_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‌،؛؟٪٬«»"
# Letters by their plain form.
PLAIN = {"ٱإأ": "ا", "ؤ": "و", "ىي": "ی", "ك": "ک", "ة": "ه"}
# The letters whose presentation forms are read as the letter itself.
SHAPED = "ءأإئآؤابةتثجحخدذرزسشصضطظعغفقكلمنهوىي"
# The character that stands for LAM MEDIAL (it is GHAIN MEDIAL), and the true one, which is not read.
LAM_MEDIAL, UNREAD = "ﻐ", "ﻠ"
LAM_ALEF = "ﻵ-ﻼ"
# Punctuation and letters of the CTC form.
CTC_PUNCTUATION = ",?؛:!؟._–«»#&()…=\"'،ـ"
FOLDED, FOLDED_TO = "يىكةۀ", "ییکهه"


def plain_of(letter: str) -> str:
    return next((b for a, b in PLAIN.items() if letter in a), letter)


def shape_pairs() -> tuple[str, str]:
    """Characters and their plain letters: the rules above and every presentation form of the shaped letters."""
    out = {a: b for group, b in PLAIN.items() for a in group}
    for c in range(0xFE70, 0xFEFD):
        kind, *rest = unicodedata.decomposition(chr(c)).split() or [""]
        if kind in ("<isolated>", "<initial>", "<medial>", "<final>") and len(rest) == 1 and (letter := chr(int(rest[0], 16))) in SHAPED:
            out[chr(c)] = plain_of(letter)
    del out[UNREAD]
    out[LAM_MEDIAL] = "ل"
    return "".join(out), "".join(out.values())


def squeeze(c: Column) -> Column:
    """Blanks become one space each, outer blanks go."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def in_class(characters: str) -> str:
    return "[" + "".join("\\" + x if x in r"\[]^-&~" else x for x in characters) + "]+"


def nfkc(c: Column | str) -> Column:
    """Compatibility composition (NFKC); null for null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(c)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reform(c: Column | str) -> Column:
    """Arabic letters and presentation forms as plain Persian letters."""
    a, b = shape_pairs()
    return F.translate(F.regexp_replace(col(c), f"[{LAM_ALEF}]", "لا"), a, b)


def standardize(c: Column | str) -> Column:
    """Lower case, plain letters, punctuation to blanks, all but the standard letters deleted (line ends and digits too)."""
    spaced = F.regexp_replace(reform(F.lower(col(c))), in_class(STANDARD_PUNCTUATION), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, f"[^ {STANDARD_LETTERS}]+", ""), " +", " "))


def plain_text(c: Column | str) -> Column:
    """A label without the language prefix of speech models."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^language[\s\x{1c}-\x{1f}\x{85}\p{Z}]+[^<]+<asr_text>", ""), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def after_marker(c: Column | str) -> Column:
    """What follows the first <asr_text>, or all where there is none."""
    at = F.instr(col(c), F.lit("<asr_text>"))
    return F.when(at > 0, F.substr(col(c), at + len("<asr_text>"))).otherwise(col(c))


def digits_to_ascii(c: Column) -> Column:
    """Decimal digits of all scripts as 0-9."""
    nd = [chr(x) for x in range(0x80, 0x20000) if unicodedata.category(chr(x)) == "Nd"]
    return F.translate(c, "".join(nd), "".join(str(unicodedata.digit(x)) for x in nd))


def normalize_eval(c: Column | str, compose: bool = True) -> Column:
    """The evaluation form: prefix off, NFKC, Persian yeh and kaf, non-joiners and punctuation to blanks, ASCII digits.

    compose=False leaves the NFKC step out, for texts known to be in that form.
    """
    text = plain_text(c)
    text = F.translate(nfkc(text) if compose else text, "يك" + ZWNJ, "یک ")
    return squeeze(F.regexp_replace(digits_to_ascii(text), rf"[\p{{P}}{NEW_PUNCTUATION}]", " "))


def normalize_chunk(c: Column | str, compose: bool = True) -> Column:
    """The chunker's form: NFKC, folded letters, all but Latin letters, digits and the Arabic block to blanks."""
    text = F.translate(nfkc(col(c)) if compose else col(c), FOLDED, FOLDED_TO)
    return squeeze(F.regexp_replace(text, r"(?U)[^0-9A-Za-z\x{0600}-\x{06ff}\s\x{1c}-\x{1f}]+", " "))


def normalize_ctc(c: Column | str) -> Column:
    """The CTC form: after the marker, folded letters, listed punctuation to blanks, no vowel marks, lower case."""
    text = F.translate(after_marker(c), FOLDED, FOLDED_TO)
    text = F.regexp_replace(F.regexp_replace(text, in_class(CTC_PUNCTUATION), " "), "[ً-ْ]", "")
    return squeeze(F.lower(F.translate(text, ZWNJ, " ")))


def prompt(language: Column | str, text: Column | str) -> Column:
    """The label of a speech model: language and text."""
    return F.concat(F.lit("language "), col(language), F.lit("<asr_text>"), col(text))


def chat_prefix(prompt_text: Column | str = "", language: Column | None = None) -> Column:
    """What a speech model is given before the label: the system prompt, the place of the audio, and the assistant's turn."""
    system = F.coalesce(col(prompt_text), F.lit("")) if isinstance(prompt_text, Column) else F.lit(prompt_text)
    # The marks of turns and of audio.
    head, mid = F.lit("<|im_start|>system\n"), F.lit("<|im_end|>\n<|im_start|>user\n<|audio_start|><|audio_pad|><|audio_end|><|im_end|>\n<|im_start|>assistant\n")
    return F.concat(head, system, mid) if language is None else F.concat(head, system, mid, F.lit("language "), language, F.lit("<asr_text>"))


def safe_id(c: Column | str) -> Column:
    """A name fit for files: other characters as one underscore, none outside; `recording` if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(squeeze(col(c)), r"[^0-9A-Za-z\x{0600}-\x{06ff}_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("recording"))


def pair_key(stem: Column | str) -> Column:
    """The key by which audio and text files are paired: lower case, known prefixes and separators off."""
    low = F.lower(col(stem))
    key = F.regexp_replace(F.regexp_replace(low, r"^(?:voice|audio|recording|text|transcript)[-_ ]*", ""), r"[^0-9a-z\x{0600}-\x{06ff}]+", "")
    return F.coalesce(F.nullif(key, F.lit("")), low)


def padded_id(prefix: Column | str, number: Column | str, width: int = 4, joint: str = "_chunk_") -> Column:
    """prefix, joint and the zero-padded number, which is not cut when it is longer."""
    return F.concat(col(prefix), F.lit(joint), F.format_string(f"%0{width}d", col(number).cast("bigint")))


def stem(path: Column | str) -> Column:
    """File name without folders and last suffix."""
    return F.regexp_replace(F.regexp_extract(col(path), r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def relocate(path: Column | str, folder: str) -> Column:
    """The file's name under another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(col(path), r"[^/]*$", 0))


# Language codes.
LANGUAGES = {"fa": "Persian", "zh": "Chinese", "zh-cn": "Chinese", "ja": "Japanese", "en": "English"}


def language_name(code: Column | str) -> Column:
    """The language of a code; other values pass."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(col(code))), col(code))


def words(c: Column | str) -> Column:
    """Blank-separated words; null for null."""
    return F.filter(F.split(col(c), BLANKS), lambda x: x != "")
