"""One form for texts that look the same in print.

Arrow string buffers are viewed as numpy arrays of code points.  A lookup table gives every code point
its replacement and its number of output code points; replacements are gathered with expansion offsets,
marks are put in canonical order and composed on whole arrays.  No string method is called per row.

Folded (not seen by a reader): width and shape forms, composed against combining spelling, kind and
number of blanks, outer blanks, characters without width, Arabic against Persian yeh and kaf, digits
drawn alike, Cyrillic and Greek letters drawn like Latin ones.  Kept: case, vowel marks, hamza, madda,
punctuation, digits drawn differently, tatweel, and one non-joiner between letters that would join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import row_slices

SIZE = 0x110000
#: Stands at the end of each row while rows are processed together.
END = SIZE
ZWNJ = 0x200C
TATWEEL = 0x0640
HAMZA_ABOVE = 0x0654

# Letters of other scripts drawn like Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухѕіјԁһԛԝԚԜҮӀ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaeopcyxsijdhqwQWYI"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϹϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXoCcj"
# Arabic-script letters and digits drawn alike, as written and as kept.
ARABIC = "يىك٠١٢٣٧٨٩"
PERSIAN = "ییک۰۱۲۳۷۸۹"
# Format characters that have width.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Characters without width outside category Cf.
WIDTHLESS = {0x34F, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x17B4, 0x17B5}
# Decompositions that change only width or shape.
SHAPE_TAGS = {"<wide>", "<narrow>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
LATIN_LIGATURES = range(0xFB00, 0xFB18)
# Words in the names of Arabic letters that join only to the letter before.
RIGHT_JOINING = ("ALEF", "DAL", "DDAL", "THAL", "DUL", "REH", "RREH", "ZAIN", "JEH", "WAW", "TEH MARBUTA", "OE", "U", "YU", "KIRGHIZ OE", "VE", "AE")

BLANK, DROP, NON_JOINER, DUAL, RIGHT = 1, 2, 4, 8, 16


class Tables:
    """Lookup tables over all code points, built from the Unicode data by the rules above."""

    def __init__(self) -> None:
        name, category = unicodedata.name, unicodedata.category
        twin = {ord(a): ord(b) for a, b in zip(CYRILLIC + GREEK + ARABIC, CYRILLIC_LATIN + GREEK_LATIN + PERSIAN)}
        twin[0x6D5] = 0x6D5
        flags = np.zeros(SIZE + 1, np.uint8)
        ccc = np.zeros(SIZE + 1, np.uint8)
        width = np.ones(SIZE + 1, np.uint8)
        first = np.arange(SIZE + 1, dtype=np.uint32)
        more: dict[int, list[int]] = {}
        initial, final = set(), set()
        parts: dict[int, list[int]] = {}
        spans = [*range(0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
        for c in spans:
            ch = chr(c)
            kind = category(ch)
            ccc[c] = unicodedata.combining(ch)
            if kind == "Zs" or ch.isspace():
                flags[c] |= BLANK
                first[c] = 0x20
                continue
            if c == ZWNJ:
                flags[c] |= NON_JOINER
                continue
            if (kind == "Cf" and c not in VISIBLE_FORMAT) or c in WIDTHLESS or kind == "Cc":
                flags[c] |= DROP
                continue
            d = unicodedata.decomposition(ch).split()
            if d and (d[0][0] != "<" or d[0] in SHAPE_TAGS or (d[0] == "<compat>" and c in LATIN_LIGATURES)):
                parts[c] = [int(x, 16) for x in d if x[0] != "<"]
                if d[0] in ("<initial>", "<final>") and len(parts[c]) == 1:
                    (initial if d[0] == "<initial>" else final).add(parts[c][0])

        def whole(c: int) -> list[int]:
            if c == 0x6C0:  # heh with hamza, written on either heh
                return [0x647, HAMZA_ABOVE]
            return [x for p in parts[c] for x in whole(p)] if c in parts else [0x20 if flags[c] & BLANK else twin.get(c, c)]

        for c in {*parts, *twin}:
            out = whole(c)
            first[c], width[c] = out[0], len(out)
            if len(out) > 1:
                more[c] = out
        at = np.zeros(SIZE + 1, np.int32)
        pool = [0]
        for c, out in more.items():
            at[c] = len(pool)
            pool += out
        for c in [*range(0x620, 0x64B), *range(0x66E, 0x6D6), *range(0x6EE, 0x700), *range(0x750, 0x780), *range(0x8A0, 0x8C8)]:
            if category(chr(c)) != "Lo" or c in (0x621, 0x674, 0x6D5):
                continue
            word = name(chr(c)).removeprefix("ARABIC LETTER ").split(" WITH ")[0]
            flags[c] |= DUAL if c in initial else RIGHT if c in final or word in RIGHT_JOINING else DUAL
        flags[[TATWEEL]] |= DUAL
        flags[[0x6D5]] |= RIGHT
        # A pair that composes: a starter and one mark, both after folding.
        pairs = {}
        for c in spans:
            d = parts.get(c, [])
            if len(d) == 2 and not unicodedata.decomposition(chr(c)).startswith("<") and unicodedata.normalize("NFC", chr(c)) == chr(c):
                a, b = twin.get(d[0], d[0]), d[1]
                if ccc[b] and not ccc[a]:
                    pairs.setdefault((a << 21) | b, twin.get(c, c))
        pairs[(0x647 << 21) | HAMZA_ABOVE] = 0x6C0
        keys = np.array(sorted(pairs), np.int64)
        self.flags, self.ccc, self.width, self.first, self.at = flags, ccc, width, first, at
        self.pool, self.keys = np.array(pool, np.uint32), keys
        self.values = np.array([pairs[k] for k in keys.tolist()], np.uint32)
        self.involved = (width > 1) | (ccc > 0)
        self.involved[0x1100:0x1200] = True
        lower = np.arange(SIZE + 1, dtype=np.uint32)
        alpha = np.zeros(SIZE + 1, bool)
        for c in range(0x32000):
            if not 0xD800 <= c < 0xE000:
                ch = chr(c)
                alpha[c] = ch.isalpha()
                if len(low := ch.lower()) == 1:
                    lower[c] = ord(low)
        alpha[TATWEEL] = False
        self.lower, self.alpha = lower, alpha


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of an Arrow string array in one array, and the offsets of its rows. Null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[offsets - offsets[0]] if len(texts) else np.zeros(1, np.int64)


def to_strings(points: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of code_points; rows of null, if given, become null."""
    sizes = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=sizes[1:])
    data = pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"))
    mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null is not None and null.any() else None
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(np.ascontiguousarray(sizes[offsets])), data])
    return out.cast(pa.string())


def expand(points: np.ndarray, t: Tables) -> np.ndarray:
    """Each code point replaced by its one or more code points."""
    width = t.width[points]
    if (width == 1).all():
        return t.first[points]
    ends = np.cumsum(width, dtype=np.int64)
    out = np.repeat(t.first[points], width)
    wide = np.flatnonzero(width > 1)
    sizes = width[wide].astype(np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(ends[wide] - sizes, sizes) + within] = t.pool[np.repeat(t.at[points[wide]].astype(np.int64), sizes) + within]
    return out


def order_marks(points: np.ndarray, t: Tables) -> np.ndarray:
    """Marks after a letter in the order of their combining classes, equal classes as they stand."""
    ccc = t.ccc[points]
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:])
    if wrong.any():
        key = np.cumsum(ccc == 0, dtype=np.int64) * 256 + ccc
        points = points[np.argsort(key, kind="stable")]
    return points


def compose(points: np.ndarray, t: Tables) -> np.ndarray:
    """Neighbouring pairs of letter and mark, and of Hangul parts, become one code point where there is one."""
    while True:
        marks = np.flatnonzero(t.ccc[points] > 0)
        marks = marks[marks > 0]
        key = (points[marks - 1].astype(np.int64) << 21) | points[marks]
        at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        hit = t.keys[at] == key
        if not hit.any():
            break
        points = points.copy()
        points[marks[hit] - 1] = t.values[at[hit]]
        points = np.delete(points, marks[hit])
    if ((points >= 0x1100) & (points < 0x1200)).any():
        points = points.copy()
        v = np.flatnonzero((points[1:] >= 0x1161) & (points[1:] <= 0x1175) & (points[:-1] >= 0x1100) & (points[:-1] <= 0x1112)) + 1
        points[v - 1] = 0xAC00 + ((points[v - 1] - 0x1100) * 21 + points[v] - 0x1161) * 28
        points = np.delete(points, v)
        lv = (points[:-1] >= 0xAC00) & (points[:-1] <= 0xD7A3) & ((points[:-1] - 0xAC00) % 28 == 0)
        w = np.flatnonzero(lv & (points[1:] >= 0x11A8) & (points[1:] <= 0x11C2)) + 1
        points[w - 1] += points[w] - 0x11A7
        points = np.delete(points, w)
    return points


def fold(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of rows given as code points and offsets."""
    t = tables()
    n = len(offsets) - 1
    x = np.empty(len(points) + n, np.uint32)
    body = np.ones(len(x), bool)
    body[offsets[1:] + np.arange(n)] = False
    x[body], x[~body] = points, END
    x = x[(t.flags[x] & DROP) == 0]
    x = order_marks(expand(x, t), t)
    kind = t.flags[x]
    # A non-joiner stays, once, where the letters on both sides, marks left out, would join.
    zw = np.flatnonzero(kind & NON_JOINER)
    if len(zw):
        solid = np.flatnonzero(((kind & NON_JOINER) == 0) & (t.ccc[x] == 0))
        place = np.searchsorted(solid, zw)
        before = solid[np.maximum(place - 1, 0)]
        after = solid[np.minimum(place, len(solid) - 1)]
        joins = (place > 0) & ((kind[before] & DUAL) > 0) & ((kind[after] & (DUAL | RIGHT)) > 0)
        joins[1:] &= place[1:] != place[:-1]
        keep = np.ones(len(x), bool)
        keep[zw[~joins]] = False
        x = order_marks(x[keep], t)
    blank = x == 0x20
    edge = np.ones(len(x), bool)
    edge[1:] = blank[:-1] | (x[:-1] == END)
    edge[:-1] &= True
    keep = ~(blank & edge)
    x = x[keep]
    last = np.zeros(len(x), bool)
    last[:-1] = (x[:-1] == 0x20) & (x[1:] == END)
    x = compose(x[~last], t)
    ends = np.flatnonzero(x == END)
    out = np.zeros(n + 1, np.int64)
    out[1:] = ends - np.arange(n)
    return x[x != END], out


def only_letters(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The alphabetic code points of folded rows, without case."""
    t = tables()
    keep = t.alpha[points]
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return t.lower[points[keep]], before[offsets]


def in_slices(one: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A function of a text array, done for a bounded amount of text at a time."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([one(texts[a:b]) for a, b in row_slices(texts)] or [pa.array([], pa.string())])

    return run


@in_slices
def form_array(texts: pa.Array) -> pa.Array:
    """The form of each text of an Arrow array; null stays null."""
    return to_strings(*fold(*code_points(texts)), null=np.asarray(texts.is_null()))


@in_slices
def letters_array(texts: pa.Array) -> pa.Array:
    """The letters of each text of an Arrow array; null stays null."""
    t = tables()
    points, offsets = code_points(texts)
    # Where nothing expands or composes, the letters don't depend on their neighbours.
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(t.involved[points], out=before[1:])
    hard = before[offsets[1:]] > before[offsets[:-1]]
    rows = np.repeat(hard, np.diff(offsets))
    sizes = np.diff(offsets)
    letter, ends = only_letters(t.first[points[~rows]], np.concatenate([[0], np.cumsum(np.where(hard, 0, sizes))]))
    if hard.any():
        more, more_ends = only_letters(*fold(points[rows], np.concatenate([[0], np.cumsum(sizes[hard])])))
        counts = np.diff(ends)
        counts[hard] = np.diff(more_ends)
        at = np.repeat(hard, counts)
        out = np.empty(len(at), np.uint32)
        out[at], out[~at] = more, letter
        letter, ends = out, np.concatenate([[0], np.cumsum(counts)])
    return to_strings(letter, ends, null=np.asarray(texts.is_null()))


def visual_form(text: Column | str) -> Column:
    """The form of a text: two texts have equal forms exactly if they look the same.

    Null gives null; a text of blanks and characters without width gives the empty string. Texts may
    be of any length; the form of a form is itself.
    """
    return F.arrow_udf(lambda texts: form_array(texts), "string")(text)


def letters(text: Column | str) -> Column:
    """The letters of a text: its form's alphabetic characters in lower case, without tatweel and marks. Null gives null."""
    return F.arrow_udf(lambda texts: letters_array(texts), "string")(text)
