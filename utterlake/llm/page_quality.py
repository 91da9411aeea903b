"""Keyword-stuffed pages, link lists and tag lists.

Pages are cut into phrases at line ends, separators and sentence ends.  Runs of short phrases without function
words, links, and stretches whose words keep coming back, near by or on the whole page, are list-dense.
Short phrases and overlapping word shingles of all text are exploded with their page's host, and their distinct hosts
are counted over the whole corpus.  What stands on enough hosts counts as list material too where function words are few,
and of every page that is list-dense a share must be proven: phrases that stand on another host, or again on the page, or links.
A page is flagged when more than half of its characters are list material and enough of it is proven.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import row_slices
from .visual_form import SIZE, TATWEEL, code_points, tables

# Words of sentences rather than of titles, keywords or tags.
FUNCTION_WORDS = """
را در از به با تا برای بدون روی زیر پشت کنار که و ولی اما اگر چون وقتی
the a an of to in on at by for with from and or but because while if under over after before beside behind near inside across without
""".split()
# The same of Han characters.
HAN_FUNCTION = "的了和在是与就都而及着把被从对向给"
# Han characters of a shingle; words of other scripts make shingles of two.  Words of the filter of units.
HAN_SHINGLE, FILTER_WORDS = 4, 1 << 18
# Characters between phrases; the second group does so at line ends or before a blank only.
SEPARATORS = "\n\r\t#|»«>›→•·*/;؛،,、"
ENDS = ".!?؟。！？…"
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)
LETTER, IN_WORD, DIGIT, SPACE, BREAK, END, HAN, OPEN = 1, 2, 4, 8, 16, 32, 64, 128


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Flags of all code points, and the letter that stands for each in words."""
    t = tables()
    flags = np.zeros(SIZE + 1, np.uint8)
    base = t.first.copy()
    flags[t.alpha[np.minimum(base, SIZE)]] |= LETTER
    flags[(t.ccc > 0) | ((t.flags & 6) > 0)] |= IN_WORD
    flags[TATWEEL] |= IN_WORD
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and chr(c).isdecimal():
            flags[c] |= DIGIT
    flags[(t.flags & 1) > 0] |= SPACE
    flags[[ord(c) for c in SEPARATORS]] |= BREAK
    flags[[ord(c) for c in ENDS]] |= END
    flags[0x3400:0xA000] |= HAN
    flags[0x20000:0x32000] |= HAN
    flags[[ord(c) for c in "[]()"]] |= OPEN
    return flags, t.lower[base]


def words_of(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First letters, hashes and kind (Han) of words; a Han character is a word, marks and joiners don't part words."""
    flags, base = classes()
    kind = flags[points]
    at = np.flatnonzero(kind & LETTER)
    han = (kind[at] & HAN) > 0
    # Two letters are of one word if nothing but marks and joiners stands between them.
    solid = np.cumsum((kind & (LETTER | IN_WORD)) == 0)
    new = np.ones(len(at), bool)
    new[1:] = (solid[at[1:]] != solid[at[:-1]]) | han[1:] | han[:-1] | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    power = np.full(len(at) + 1, ODD, np.uint64)
    power[0] = 1
    back = np.full(len(at) + 1, ODD_INVERSE, np.uint64)
    back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum((base[points[at]].astype(np.uint64) + np.uint64(0x51ED27)) * power[:-1], out=total[1:])
    last = np.append(first[1:], len(at))
    value = (total[last] - total[first]) * back[first]
    return at[first], value ^ (value >> np.uint64(29)), han[first]


@lru_cache(maxsize=1)
def function_hashes() -> np.ndarray:
    points, offsets = code_points(pa.array(FUNCTION_WORDS))
    return np.sort(words_of(points, np.repeat(np.arange(len(FUNCTION_WORDS)), np.diff(offsets)))[1])


@lru_cache(maxsize=1)
def han_function_hashes() -> np.ndarray:
    points, offsets = code_points(pa.array([HAN_FUNCTION]))
    return np.sort(words_of(points, np.zeros(len(points), np.int64))[1])


def among(value: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value


def on_page(same: np.ndarray, heads: np.ndarray, word_row: np.ndarray, rarest: int | None) -> np.ndarray:
    """Words that stand at least twice on their whole page, and are at least one in rarest of its words (if given)."""
    if not len(same):
        return np.zeros(0, bool)
    key = (same ^ (word_row.astype(np.uint64) * np.uint64(ODD))) * np.uint64(0xD6E8FEB86659FD93)
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[number] >= (2 if rarest is None else np.maximum(2, np.diff(heads)[word_row] / rarest))


def shingles(value: np.ndarray, han: np.ndarray, word: np.ndarray, word_row: np.ndarray, glue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word and hash of overlapping shingles: two words without function words, or HAN_SHINGLE Han characters."""
    first, last, digest = [], [], []
    for size, kind in ((2, ~han), (HAN_SHINGLE, han)):
        n = max(0, len(value) - size + 1)
        ok = np.ones(n, bool)
        total = np.full(n, size, np.uint64)
        for k in range(size):
            ok &= kind[k : k + n] & (word_row[k : k + n] == word_row[:n])
            ok &= word[k : k + n] == word[:n] + k if size == HAN_SHINGLE else ~glue[k : k + n]
            total = (total ^ value[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            total ^= total >> np.uint64(32)
        at = np.flatnonzero(ok)
        first.append(at)
        last.append(at + size - 1)
        digest.append(total[at])
    return np.concatenate(first), np.concatenate(last), np.concatenate(digest)


def spread(start: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Values held from each start to the next."""
    out = np.zeros(size, value.dtype)
    if len(start):
        out[start[0] :] = np.repeat(value, np.diff(np.append(start, size)))
    return out


def list_material(points: np.ndarray, offsets: np.ndarray, most_words: int, most_han: int, least_run: int, lags: int, window: int, dense: float, most_plain: float, rarest: int) -> tuple[np.ndarray, ...]:
    """Per row the characters that are list material; those that hosts may make such (open); and of both those that
    a link or a phrase that stands again on the page proves, and those that hosts may prove.

    Then all units, short phrases and shingles: row, hash, and first and last place among the open and among the unproven characters.
    """
    n, size = len(offsets) - 1, len(points)
    row = np.repeat(np.arange(n), np.diff(offsets))
    flags, _ = classes()
    t = tables()
    points = np.where(t.flags[points] & 1, points, t.first[points])
    kind = flags[points]
    word, value, han = words_of(points, row)
    # Links: runs of characters without blanks or brackets that hold "://" or begin with "www.".
    colon = np.flatnonzero((points[:-2] == 58) & (points[1:-1] == 47) & (points[2:] == 47)) if size > 2 else np.zeros(0, np.int64)
    www = np.flatnonzero((points[:-3] == 119) & (points[1:-2] == 119) & (points[2:-1] == 119) & (points[3:] == 46)) if size > 3 else np.zeros(0, np.int64)
    gap = (kind & (SPACE | OPEN)) > 0
    edge = np.zeros(size, bool)
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    run = np.cumsum(gap | edge)
    linked = np.zeros(int(run[-1]) + 1 if size else 1, bool)
    linked[run[colon]] = linked[run[www]] = True
    link = linked[run] & ~gap
    # Mark-up tags, from an angle to the next one.
    left, right = np.flatnonzero(points == 60), np.flatnonzero(points == 62)
    close = np.searchsorted(right, left)
    left, close = left[close < len(right)], right[close[close < len(right)]]
    ok = (row[left] == row[close]) & (close - left < 400)
    edges = np.bincount(left[ok], minlength=size + 1) - np.bincount(close[ok] + 1, minlength=size + 1)
    link |= np.cumsum(edges[:size]) > 0
    # Phrases begin after a separator, at either end of a link, after a sentence end before a blank, and at " - ".
    cut = edge.copy()
    apart = ((kind & BREAK) > 0) & ~link
    blank_next = np.zeros(size, bool)
    blank_next[:-1] = (kind[1:] & SPACE) > 0
    ended = ((kind & END) > 0) & ~link & (blank_next | ((kind & HAN) > 0) | (points == 0x3002))
    dash = np.zeros(size, bool)
    if size > 2:
        dash[1:-1] = ((points[1:-1] == 45) | (points[1:-1] == 0x2013) | (points[1:-1] == 0x2014)) & ((kind[:-2] & SPACE) > 0) & ((kind[2:] & SPACE) > 0)
    cut[1:] |= (apart | ended | dash)[:-1] | (link[1:] != link[:-1])
    phrase_at = np.flatnonzero(cut)
    phrase = np.cumsum(cut) - 1
    phrases = len(phrase_at)
    phrase_row, chars = row[phrase_at], np.diff(np.append(phrase_at, size))
    is_link = link[phrase_at]
    of = phrase[word]
    count = np.bincount(of, minlength=phrases)
    hans = np.bincount(of, weights=han, minlength=phrases)
    plain_word = among(value, function_hashes()) & ~han
    glue = plain_word | (among(value, han_function_hashes()) & han)
    plain = np.bincount(of[plain_word], minlength=phrases)
    short = (count > 0) & (count - hans <= most_words) & (hans <= most_han) & (plain == 0) & ~is_link
    # Runs of short phrases and links; phrases without letters follow what is before them.
    told = np.flatnonzero((count > 0) | is_link)
    item = (short | is_link)[told]
    new = np.ones(len(told), bool)
    new[1:] = (item[1:] != item[:-1]) | (phrase_row[told[1:]] != phrase_row[told[:-1]])
    number = np.cumsum(new) - 1
    length = np.bincount(number, minlength=1)[number] if len(told) else np.zeros(0, np.int64)
    sure = np.zeros(phrases, bool)
    sure[told] = item & ((length >= least_run) | is_link[told])
    silent = np.ones(phrases, bool)
    silent[told] = False
    before = np.maximum.accumulate(np.where(silent, 0, np.arange(phrases))) if phrases else np.zeros(0, np.int64)
    sure |= silent & sure[before] & (phrase_row[before] == phrase_row) if phrases else sure
    listed = sure[phrase] if size else np.zeros(0, bool)
    # Stretches whose words keep coming back; of Han, pairs of characters.
    same = value.copy()
    pair = np.zeros(len(word), bool)
    pair[:-1] = han[:-1] & han[1:] & (word[1:] == word[:-1] + 1)
    same[:-1] = np.where(pair[:-1], value[:-1] * np.uint64(31) + value[1:], value[:-1])
    again = np.zeros(len(word), bool)
    word_row = row[word]
    for lag in range(1, 2 * lags + 1):
        hit = same[lag:] == same[:-lag]
        if lag > lags:
            hit &= han[lag:]
        again[lag:] |= hit
    # The words that open a row have nothing of their own row before them.
    heads = np.searchsorted(word_row, np.arange(n + 1))
    index = np.arange(len(word))
    early = np.flatnonzero(again & (index - heads[word_row] < 2 * lags))
    for k in early.tolist():
        back = same[max(heads[word_row[k]], k - (2 * lags if han[k] else lags)) : k]
        again[k] = (back == same[k]).any()
    sums = np.concatenate([[0], np.cumsum(again & ~plain_word)])
    plains = np.concatenate([[0], np.cumsum(plain_word)])
    low = np.maximum(index - window // 2, heads[word_row])
    high = np.minimum(index + window // 2 + 1, heads[word_row + 1])
    share = (sums[high] - sums[low]) / np.maximum(high - low, 1)
    told = (plains[high] - plains[low]) / np.maximum(high - low, 1)
    wide = high - low >= window // 2
    stuffed = (share >= dense) & (told <= most_plain) & wide
    # The same by what recurs on the whole page, where Han function characters are few too.
    sums = np.concatenate([[0], np.cumsum((again | on_page(same, heads, word_row, rarest)) & ~glue)])
    glues = np.concatenate([[0], np.cumsum(glue)])
    share = (sums[high] - sums[low]) / np.maximum(high - low, 1)
    terse = ((glues[high] - glues[low]) / np.maximum(high - low, 1) <= most_plain) & wide
    stuffed |= (share >= dense) & terse
    ends = np.append(word[1:], size)
    ends = np.minimum(ends, offsets[1:][word_row])
    edges = np.bincount(word[stuffed], minlength=size + 1) - np.bincount(ends[stuffed], minlength=size + 1)
    listed |= np.cumsum(edges[:size]) > 0
    # Hosts may make list material of short phrases, and of shingles in terse stretches.
    # Short prose may have few function words by chance: hosts need whole windows.
    terse &= high - low >= window
    edges = np.bincount(word[terse], minlength=size + 1) - np.bincount(ends[terse], minlength=size + 1)
    spare = np.cumsum(edges[:size]) > 0
    loose = (spare | short[phrase]) & ~listed if size else np.zeros(0, bool)
    # The hash of a short phrase is over its words in order.
    brief = np.flatnonzero(short)
    start = np.searchsorted(of, np.arange(phrases))
    place = (np.arange(len(word)) - start[of]).astype(np.uint64)
    mixed = (value + place * np.uint64(ODD)) * np.uint64(0xD6E8FEB86659FD93)
    totals = np.concatenate([[np.uint64(0)], np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)])
    stop = np.searchsorted(of, np.arange(phrases), side="right")
    first, last, digest = shingles(value, han, word, word_row, glue)
    unit = np.concatenate([(totals[stop] - totals[start])[brief], digest]).view(np.int64)
    unit_row = np.concatenate([phrase_row[brief], word_row[first]])
    head = np.concatenate([phrase_at[brief], word[first]])
    tail = np.concatenate([(phrase_at + chars)[brief], ends[last]])
    # Proven on the page itself: links, and units that stand there again.
    twice = on_page(unit.view(np.uint64), np.array([0, len(unit)]), unit_row, None)
    edges = np.bincount(head[twice], minlength=size + 1) - np.bincount(tail[twice], minlength=size + 1)
    proven = link | (np.cumsum(edges[:size]) > 0)
    zone = listed | loose
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (listed, loose, zone & proven, zone & ~proven)]
    opened, unproven = sums[1], sums[3]
    # Of shingles only those in terse stretches make list material; all units prove.
    makes = np.concatenate([np.ones(len(brief), bool), spare[word[first]] & spare[word[last]]])
    at, to, from_, until = opened[head], np.where(makes, opened[tail], opened[head]), unproven[head], unproven[tail]
    order = np.argsort(unit_row, kind="stable")
    return (*(x[offsets[1:]] - x[offsets[:-1]] for x in sums), unit_row[order], unit[order], *(x[order] for x in (at, to, from_, until)))


PLACES = ("first", "last", "from", "until")
MATERIAL = "doc_id bigint, page bigint, chars bigint, listed bigint, proven bigint, unproven bigint, unit array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in PLACES)


def material_batches(share: float, *parameters: float):
    """Per page its characters, list material and what of it is proven; and the units of pages that are list-dense, or could be by what hosts make such."""
    counts = ("doc_id", "page", "chars", "listed", "proven", "unproven")
    schema = pa.schema([(c, pa.int64()) for c in counts] + [(c, pa.list_(pa.int64())) for c in ("unit", *PLACES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch["text"]):
                part = batch[a:b]
                points, offsets = code_points(part["text"])
                n, chars = part.num_rows, np.diff(offsets)
                got, opened, proven, unproven, row, unit, *places = list_material(points, offsets, *parameters)
                near = got + opened > share * chars
                keep = near[row] & ((places[1] > places[0]) | (places[3] > places[2]))
                row = row[keep]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep])) for x in (unit, *places)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["page"], *map(pa.array, (chars, got, proven, unproven)), *lists], schema=schema)

    return run


def unit_batches(bits: np.ndarray, *parameters: float):
    """Units of all pages that the filter lets through, with the page's host."""
    schema = pa.schema([("unit", pa.int64()), ("host", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch["text"]):
                part = batch[a:b]
                _, _, _, _, row, unit, *_ = list_material(*code_points(part["text"]), *parameters)
                word = bits[(unit.view(np.uint64) >> np.uint64(6)).astype(np.int64) & (FILTER_WORDS - 1)]
                keep = (word >> (unit & 63).astype(np.uint64)) & np.uint64(1) > 0
                yield pa.RecordBatch.from_arrays([pa.array(unit[keep]), part["host"].take(pa.array(row[keep]))], schema=schema)

    return run


def unit_filter(units: DataFrame) -> np.ndarray | None:
    """A bit for the low bits of every unit's hash, of a fixed size; None without units."""
    word = units.groupBy(F.shiftrightunsigned("unit", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int").alias("word"))
    got = word.agg(F.expr("bit_or(shiftleft(1L, cast(unit & 63 as int)))").alias("bits")).toArrow()  # at most FILTER_WORDS rows
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits if got.num_rows else None


def covered(parts: Column, kind: str) -> Column:
    """Length of the union of sorted stretches (first, last): each character counts once."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["last"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"]))).alias("total")
    )
    return F.aggregate(parts, start, step)["total"].alias(kind)


def list_pages(
    documents: DataFrame, share: float = 0.5, least_hosts: int = 3, proof: float = 0.2, most_words: int = 5, most_han: int = 10, least_run: int = 4, lags: int = 16, window: int = 20, dense: float = 0.5,
    most_plain: float = 0.08, rarest: int = 200,
) -> DataFrame:
    """Pages more than share of whose characters are repeated keywords, lists of links or titles, or tags and codes.

    documents: doc_id, text, source; other columns are left out.  Result: doc_id, list_share, distinct.
    A phrase is short with at most most_words words (most_han Han characters) and no function word.
    Listed are: links; runs of least_run short phrases or links; stretches of window words at most the share
    most_plain of which are function words and the share dense of which came among the lags words before or
    recurs on the page and is one in rarest of its words; and short phrases, and in such terse stretches
    shingles of two words (four Han characters), that stand on at least least_hosts different sources anywhere in the corpus
    (a null source is no host).  Of what is list-dense, listed or possibly so, the share proof must be proven: links, and short phrases and shingles
    that stand on two sources or again on the page; in a corpus of fewer than two sources there is no other host to ask.  Units are counted
    by host before they are counted at all, so that a phrase of a third of all pages is no large group.
    Null and blank texts give no row; texts may be of any length; repeated rows of a doc_id are
    one row, with the greatest share.
    """
    parameters = (most_words, most_han, least_run, lags, window, dense, most_plain, rarest)
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("page"), F.col("source").alias("host"))
    found = pages.select("doc_id", "text", "page").mapInArrow(material_batches(share, *parameters), MATERIAL)
    found = written(found.where("chars > 0 and (listed > 0 or size(unit) > 0)"))
    one_host = documents.agg(F.min("source") == F.max("source")).first()[0] is not False
    ids = ["doc_id", "page", "chars", "listed", "proven", "unproven"]
    near = found.where(F.size("unit") > 0).select(*ids, F.explode(F.arrays_zip("unit", *PLACES)).alias("u")).select(*ids, "u.unit", *[f"u.{c}" for c in PLACES])
    bits = unit_filter(near)
    if bits is None:
        hosts = pages.select(F.lit(0).cast("bigint").alias("unit"), F.lit(0).cast("bigint").alias("hosts")).limit(0)
    else:
        hosts = (
            pages.where("host is not null").select("text", "host").mapInArrow(unit_batches(bits, *parameters), "unit bigint, host string")
            .groupBy("unit", "host").agg(F.lit(1).alias("one"))
            .groupBy("unit").agg(F.count("*").alias("hosts")).where("hosts > 1")
        )
    # Stretches of one page may overlap.
    stretches = lambda a, b, ok: F.sort_array(F.collect_set(F.when(ok & (F.col(b) > F.col(a)), F.struct(F.col(a).alias("first"), F.col(b).alias("last")))))
    by_hosts = (
        near.join(hosts, "unit").groupBy(*ids).agg(stretches("first", "last", F.col("hosts") >= least_hosts).alias("makes"), stretches("from", "until", F.col("hosts") > 1).alias("proves"))
        .select("doc_id", "page", covered(F.col("makes"), "made"), covered(F.col("proves"), "shown"))
    )
    joined = found.select(*ids).distinct().join(by_hosts, ["doc_id", "page"], "left").fillna(0, ["made", "shown"])
    all_listed = F.col("listed") + F.col("made")
    is_proven = F.lit(one_host) | (F.col("proven") + F.col("shown") >= proof * (F.col("proven") + F.col("unproven")))
    return (
        joined.where((all_listed > share * F.col("chars")) & is_proven)
        .groupBy("doc_id").agg(F.max(F.least(all_listed / F.col("chars"), F.lit(1.0))).alias("list_share"))
    )
