"""Evaluation texts leaking into training text.

Latent semantic retrieval: passages of all documents and of the evaluation items become TF-IDF vectors over
hashed words, a distributed randomised SVD of corpus passages gives a latent space of fewer dimensions than there are
items, and what the space leaves out is kept by a random projection, so that rare names count.  Passages are
searched by cosine there, candidates are compared by their exact cosine, and what is left is checked in
the text: a longest common subsequence of letter runs for passages taken over, one of words and an answer check for paraphrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cores, written
from .common import id_filter, may_hold, row_slices, split_name
from .page_quality import BREAK, END, HAN, IN_WORD, LETTER, ODD, ODD_INVERSE, among, classes
from .visual_form import code_points, expand, tables

#: Letters of a gram, and of a passage's half; a Han letter counts three times.  Items of fewer letters than SHORT
#: are no passage that a cosine could tell.
GRAM, HAN_GRAM, HALF, HAN_WEIGHT, SHORT = 8, 4, 64, 3, 40
#: Bits of the filter of grams, and of a hashed word; passages of items that are searched together.
BITS, WORD_BITS, TOGETHER = 20, 16, 1024
WORDS, NON_JOINER = 1 << WORD_BITS, 0x200C
# Stock replies, as they stand between line ends, separators and sentence ends.
STOCK = """
بله|بله بله|سلام|نه|بعدش چه شد|نمی‌دانم|یعنی چه|خیلی ممنون|خب|دوباره بگو|صبر کنید|آره|درست است|ان‌شاءالله|چه خوب
yes|no|okay|hello|thank you|thanks|i see|of course|you know|really|是的|对|好的|谢谢|不知道
""".replace("\n", "|").strip("|").split("|")


@dataclass
class Text:
    """Letters of rows: their values, rows, places in weight, whether they are Han, and numbers of their lines, phrases, words and parts of words (at non-joiners)."""

    letter: np.ndarray
    row: np.ndarray
    place: np.ndarray
    han: np.ndarray
    line: np.ndarray
    phrase: np.ndarray
    word: np.ndarray
    part: np.ndarray


def labels(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Characters of a label before the text of a line: at most 24 up to a colon and a blank or line end."""
    line = np.flatnonzero(np.concatenate([[True], (points[:-1] == 10) | (row[1:] != row[:-1])])) if len(points) else np.zeros(0, np.int64)
    colon = np.flatnonzero((points == 58) | (points == 0xFF1A))
    out = np.zeros(len(points) + 1, np.int64)
    if len(colon):
        k = np.searchsorted(colon, line)
        ok = k < len(colon)
        line, end = line[ok], colon[k[ok]]
        after = np.minimum(end + 1, len(points) - 1)
        blank = (tables().flags[points[after]] & 1) > 0
        following = np.append(line[1:], len(points))
        ok = (end - line <= 24) & (end < following) & (row[end] == row[line]) & blank
        np.add.at(out, line[ok], 1)
        np.add.at(out, end[ok] + 1, -1)
    return np.cumsum(out[:-1]) > 0


def read_letters(points: np.ndarray, offsets: np.ndarray, drop_labels: bool) -> Text:
    """The letters of rows without marks, case and look-alikes; labels before a line's text are left out."""
    flags, base = classes()
    t = tables()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if drop_labels:
        keep = ~labels(points, row)
        points, row = points[keep], row[keep]
    wide = (points >= 0xFEF5) & (points <= 0xFEFC)  # lam with alef, two letters in one
    if wide.any():
        row = np.repeat(row, t.width[points])
        points = expand(points, t)
    kind = flags[points]
    at = np.flatnonzero(kind & LETTER)
    han = (kind[at] & HAN) > 0
    letter, row = base[points[at]], row[at]
    weight = np.cumsum(np.where(han, HAN_WEIGHT, 1))
    start = np.searchsorted(row, np.arange(len(offsets) - 1))
    before = np.concatenate([[0], weight])[start]
    ended = np.concatenate([[0], np.cumsum((points == 10) | (points == 13))])[:-1]
    line = ended[at] + row
    cut = np.concatenate([[0], np.cumsum((kind & (BREAK | END)) > 0)])[:-1]
    apart = (kind & (LETTER | IN_WORD)) == 0
    place = weight - 1 - before[row] if len(at) else weight
    return Text(letter, row, place, han, line, cut[at] + row, np.cumsum(apart)[at] + row, np.cumsum(apart | (points == NON_JOINER))[at] + row)


def prefix(letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(letter)
    power, back = np.full(n + 1, ODD, np.uint64), np.full(n + 1, ODD_INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((letter.astype(np.uint64) + np.uint64(0x51ED27)) * power[:-1], out=sums[1:])
    return sums, back


def gram_hashes(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """First letters and hashes of the letter n-grams of rows: GRAM letters, or HAN_GRAM from a Han letter on."""
    n = len(text.letter)
    sums, back = prefix(text.letter)
    size = np.where(text.han, HAN_GRAM, GRAM)
    stop = np.arange(n) + size
    end = np.minimum(stop, n)
    ok = np.flatnonzero((stop <= n) & (text.row[np.maximum(end - 1, 0)] == text.row)) if n else np.zeros(0, np.int64)
    value = (sums[end[ok]] - sums[ok]) * back[ok]
    return ok, value ^ (value >> np.uint64(29))


def pieces(number: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First letters and hashes of pieces of letters, told by rising numbers."""
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    sums, back = prefix(letter)
    value = (sums[np.append(first[1:], len(letter))] - sums[first]) * back[first] if len(first) else np.zeros(0, np.uint64)
    return first, value ^ (value >> np.uint64(29))


@lru_cache(maxsize=1)
def stock_hashes() -> np.ndarray:
    text = read_letters(*code_points(pa.array(STOCK)), drop_labels=False)
    return np.sort(pieces(text.row, text.letter)[1])


def interruptions(text: Text) -> np.ndarray:
    """Letters of refrains, lines that stand more than once in their row, and of stock replies."""
    first, value = pieces(text.line, text.letter)
    key = (value ^ (text.row[first].astype(np.uint64) * np.uint64(ODD))) * np.uint64(0xD6E8FEB86659FD93)
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    refrain = np.repeat(times[number] > 1, np.diff(np.append(first, len(text.letter))))
    first, value = pieces(text.phrase, text.letter)
    return refrain | np.repeat(among(value, stock_hashes()), np.diff(np.append(first, len(text.letter))))


def word_hashes(text: Text, joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First letters and numbers, below WORDS, of the words of rows, non-joiners parting words or joined; of Han, pairs of letters, whatever stands between them."""
    of = text.word if joined else text.part
    new = np.ones(len(text.letter), bool)
    new[1:] = (of[1:] != of[:-1]) | text.han[1:] | text.han[:-1]
    first, value = pieces(np.cumsum(new), text.letter)
    if len(first):
        han, row = text.han[first], text.row[first]
        pair = np.zeros(len(first), bool)
        pair[:-1] = han[:-1] & han[1:] & (row[1:] == row[:-1])
        value[:-1] = np.where(pair[:-1], value[:-1] * np.uint64(31) + value[1:], value[:-1])
    return first, (value * np.uint64(ODD) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def halves(row: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words by half passage, in order: row and half as one number, word."""
    key = np.unique(((row << 24 | place // HALF) << WORD_BITS) | word)
    return key >> WORD_BITS, key & (WORDS - 1)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal values that each belongs to, and the first of each run."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def followed(key: np.ndarray) -> np.ndarray:
    """Where a half passage is followed by the next one of its row."""
    after = np.zeros(len(key), bool)
    after[:-1] = key[1:] == key[:-1] + 1
    return after


@dataclass
class Items:
    """Evaluation items: their letters, grams, and passages (half passages and pairs of them) of words."""

    keys: list[int]
    letters: list[np.ndarray]
    han: list[bool]
    grams: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    seen: np.ndarray
    #: Passages: the item of each; words: the passage and the word.
    item: np.ndarray
    passage: np.ndarray
    word: np.ndarray
    #: Words of each item in order, for paraphrases.
    words: list[np.ndarray]

    @staticmethod
    def of(keys: list[int], sentences: list[str]) -> Items:
        text = read_letters(*code_points(pa.array(sentences, pa.string())), drop_labels=False)
        at, value = gram_hashes(text)
        grams, gram = np.unique(value, return_inverse=True)
        seen = np.zeros(1 << BITS, bool)
        seen[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
        heads = np.searchsorted(text.row, np.arange(len(keys) + 1))
        letters = [text.letter[a:b] for a, b in zip(heads[:-1], heads[1:])]
        han = [bool(text.han[a:b].mean() > 0.5) if b > a else False for a, b in zip(heads[:-1], heads[1:])]
        first, word = word_hashes(text)
        of = np.searchsorted(first, heads)
        ordered = [word[a:b] for a, b in zip(of[:-1], of[1:])]
        # A passage is a half and the next one; a half with none after it stands alone only where it is the whole item.
        # Texts may have lost their non-joiners, so items are searched with and without.
        passage, words, item = [], [], []
        for joined in (False, True):
            first, word = word_hashes(text, joined)
            half, word = halves(text.row[first], text.place[first], word)
            number, start = runs_of(half)
            key, ends = half[start], np.append(start, len(half))
            after = followed(key)
            alone = ~after & ~np.append(False, after[:-1])
            for k in np.flatnonzero(after | alone).tolist():
                own = np.unique(word[ends[k] : ends[k + 2 if after[k] else k + 1]])
                passage.append(np.full(len(own), len(item)))
                words.append(own)
                item.append(int(key[k] >> 24))
            if not (text.word[1:] == text.word[:-1])[text.part[1:] != text.part[:-1]].any():
                break
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return Items(keys, letters, han, grams, text.row[at], gram, seen, np.array(item, np.int64), flat(passage), flat(words), ordered)

    def hits(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Letters of a text at which a gram of the items begins, and the gram."""
        at, value = gram_hashes(text)
        maybe = np.flatnonzero(self.seen[(value >> np.uint64(64 - BITS)).astype(np.int64)])
        at, value = at[maybe], value[maybe]
        k = np.minimum(np.searchsorted(self.grams, value), max(len(self.grams) - 1, 0))
        ok = self.grams[k] == value if len(self.grams) else np.zeros(0, bool)
        return at[ok], k[ok]

    def long(self) -> np.ndarray:
        """Whether an item is long enough for the search of passages."""
        return np.array([len(x) * (HAN_WEIGHT if h else 1) >= SHORT for x, h in zip(self.letters, self.han)], bool)

    def short(self) -> np.ndarray:
        """Numbers of items with letters that are not."""
        return np.flatnonzero(~self.long() & np.array([len(x) > 0 for x in self.letters], bool))


def weigh(idf: np.ndarray, number: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights of a sparse matrix of n rows, rows of unit length."""
    w = idf[word]
    norm = np.sqrt(np.bincount(number, weights=w * w, minlength=n))
    return (w / np.maximum(norm[number], 1e-12)).astype(np.float32)


def times(weight: np.ndarray | None, number: np.ndarray, word: np.ndarray, n: int, dense: np.ndarray, most: int = 1 << 12, few: int = 48) -> np.ndarray:
    """Sparse matrix, sorted by row, times a dense one, in blocks of bounded size: rows of as many entries, few at most, together, longer ones alone."""
    out = np.zeros((n, dense.shape[1]), np.float32)
    many = np.bincount(number, minlength=n)
    first = np.cumsum(many) - many
    weight = np.ones(len(number), np.float32) if weight is None else weight
    short = np.flatnonzero(many <= few)
    short = short[np.argsort(many[short], kind="stable")]
    ends = np.searchsorted(many[short], np.arange(1, few + 2))
    for size, low, high in zip(range(1, few + 1), ends[:-1].tolist(), ends[1:].tolist()):
        step = max(1, most // size)
        for a in range(low, high, step):
            rows = short[a : min(a + step, high)]
            at = first[rows, None] + np.arange(size)
            out[rows] = np.matmul(weight[at][:, None, :], dense[word[at]])[:, 0]
    for r in np.flatnonzero(many > few).tolist():
        for a in range(first[r], first[r] + many[r], most):
            part = slice(a, min(a + most, first[r] + many[r]))
            out[r] += weight[part] @ dense[word[part]]
    return out


TABLE = "doc_id bigint, half array<int>, word array<int>"


def passage_table(documents: DataFrame) -> DataFrame:
    """Distinct words by half passage of every document, one row each; documents with refrains or stock replies have one more row without them."""
    schema = pa.schema([("doc_id", pa.int64()), ("half", pa.list_(pa.int32())), ("word", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch["text"]):
                text = read_letters(*code_points(batch["text"][a:b]), drop_labels=True)
                first, word = word_hashes(text)
                row, n = text.row[first], b - a
                mute = interruptions(text)
                muted = np.zeros(n, bool)
                muted[text.row[mute]] = True
                weight = np.cumsum(np.where(text.han, HAN_WEIGHT, 1) * ~mute)
                # Places in the second view count what is left of the row only.
                heads = np.minimum(np.searchsorted(text.row, np.arange(n)), max(len(weight) - 1, 0))
                before = np.where(heads > 0, weight[heads - 1], 0) if len(weight) else np.zeros(n, np.int64)
                seen = muted[row] & ~mute[first]
                key, word = halves(
                    np.concatenate([row * 2, row[seen] * 2 + 1]), np.concatenate([text.place[first], weight[first[seen]] - 1 - before[row[seen]]]), np.concatenate([word, word[seen]])
                )
                view = key >> 24
                _, start = runs_of(view)
                ends = pa.array(np.append(start, len(key)).astype(np.int32))
                ids = batch["doc_id"][a:b].take(pa.array(view[start] >> 1))
                half = pa.array((key & 0xFFFFFF).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, half), pa.ListArray.from_arrays(ends, pa.array(word.astype(np.int32)))], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, TABLE)


def table_slices(batches: Iterator[pa.RecordBatch], most_words: int = 1 << 17) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, and row and half as one number and word of each word, of about so many words at a time; a longer row is alone."""
    for batch in batches:
        ends = batch["word"].offsets.to_numpy()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + most_words, side="right")) - 1)
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            half, word = (batch[c][a:b].flatten().to_numpy().astype(np.int64) for c in ("half", "word"))
            yield batch["doc_id"][a:b], row << 24 | half, word, row
            a = b


def added(table: DataFrame, part, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum over all tasks of arrays made by part(batches).  Rows that are zero are not sent, and sums meet by block of rows."""
    width = int(np.prod(shape[1:], dtype=np.int64))
    step = max(1, (1 << 18) // max(1, width))
    kind = "block int, row binary, part binary"

    def message(block: int, own: np.ndarray) -> dict[str, list]:
        row = np.flatnonzero(own.any(axis=1)).astype(np.int32)
        return {"block": [block], "row": [row.tobytes()], "part": [own[row].tobytes()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part(batches).reshape(shape[0], width)
        for b in range(0, shape[0], step):
            yield pa.RecordBatch.from_pydict(message(b, out[b : b + step]), schema=pa.schema([("block", pa.int32()), ("row", pa.binary()), ("part", pa.binary())]))

    def total(rows: Iterator[tuple[bytes, bytes]], n: int) -> np.ndarray:
        out = np.zeros((n, width), dtype)
        for row, values in rows:
            out[np.frombuffer(row, np.int32)] += np.frombuffer(values, dtype).reshape(-1, width)
        return out

    def add(block: pa.Table) -> pa.Table:
        own = total(zip(block["row"].to_pylist(), block["part"].to_pylist()), step)
        return pa.table(message(block["block"][0].as_py(), own), schema=pa.schema([("block", pa.int32()), ("row", pa.binary()), ("part", pa.binary())]))

    got = table.coalesce(cores(table.sparkSession)).mapInArrow(run, kind).groupBy("block").applyInArrow(add, kind).collect()
    out = np.zeros((-(-shape[0] // step) * step, width), dtype)
    for r in got:
        out[r["block"] : r["block"] + step] = total([(r["row"], r["part"])], step)
    return out[: shape[0]].reshape(shape)


@dataclass
class Space:
    """IDF of words, and word by word the latent dimensions: semantic ones of the SVD, then those of the rest."""

    idf: np.ndarray
    basis: np.ndarray
    rest: np.ndarray

    def dense(self, semantic: bool) -> np.ndarray:
        """Words by dimensions, weighted by IDF."""
        out = self.basis if semantic else np.concatenate([self.basis, self.rest], 1)
        return out.astype(np.float32) * self.idf[:, None].astype(np.float32)


def latent_space(table: DataFrame, seed: int, rank: int, rest: int, fit_passages: int | None = None) -> Space:
    """The latent space of a corpus's passages.

    Counts are over all half passages of all documents, and so is the randomised SVD with one power step: the range of (A'A) (A'A) Omega, A
    being the TF-IDF vectors of the half passages.  Tasks add up their own share; what is sent is one sketch of WORDS by rank for each
    running task, whatever the size of the corpus.  Only a caller that names fit_passages has it fitted on about so many, those of documents chosen by hash.
    """
    spark = table.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(WORDS + 1, np.int64)
        for _, key, word, _ in table_slices(batches):
            out[:WORDS] += np.bincount(word, minlength=WORDS)
            out[WORDS] += len(runs_of(key)[1])
        return out

    df = added(table, count, (WORDS + 1,), np.int64)
    total, df = int(df[WORDS]), df[:WORDS]
    idf = np.log((total + 1) / (df + 1)) + 0.1
    chosen = table if fit_passages is None or total <= fit_passages else written(table.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * fit_passages / total)))
    basis = np.random.default_rng(seed).standard_normal((WORDS, rank)).astype(np.float32)
    for _ in range(2):
        if not basis.shape[1]:  # no words at all
            break
        model = spark.sparkContext.broadcast((idf, basis))

        def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            idf, basis = model.value
            z = np.zeros_like(basis)
            for _, key, word, _ in table_slices(batches):
                number, start = runs_of(key)
                w = weigh(idf, number, word, len(start))
                y = times(w, number, word, len(start), basis)
                order = np.argsort(word.astype(np.uint16), kind="stable")  # of 16 bits a radix sort
                g, heads = runs_of(word[order])
                z[word[order[heads]]] += times(w[order], g, number[order], len(heads), y)
            return z

        basis = orthonormal(added(chosen, sketch, basis.shape, np.float32))
        model.unpersist()
    signs = (np.random.default_rng(seed + 1).integers(0, 2, (WORDS, rest)) * 2 - 1).astype(np.float32) / np.sqrt(max(1, rest))
    return Space(idf, basis.astype(np.float16), (signs - basis @ (basis.T @ signs)).astype(np.float16))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def near(table: DataFrame, items: Items, space: Space, cosine: float, exact_cosine: float | None, covered: float = 0.0) -> DataFrame:
    """Documents and the items of which a passage is near one of theirs: doc_id, item array<int>.

    Half passages, and each with the next one, are searched by cosine in the latent space; without exact_cosine in its semantic
    dimensions alone.  Candidates are then compared in all words, by cosine and by the share of the
    item passage's weight that is covered.
    """
    spark = table.sparkSession
    model = spark.sparkContext.broadcast((items.item, items.passage, items.word, items.long(), space))
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, passage, word_of, long, space = model.value
        dense = space.dense(exact_cosine is None)
        latent = unit(times(None, passage, word_of, len(item), dense)).T
        known, column = np.unique(word_of, return_inverse=True)
        place = np.full(WORDS, -1)
        place[known] = np.arange(len(known))
        weight = weigh(space.idf, passage, word_of, len(item))
        norm = np.sqrt(np.bincount(passage, weights=space.idf[word_of] ** 2, minlength=len(item)))
        blocks = []
        for a in range(0, len(item), TOGETHER):
            own = (passage >= a) & (passage < a + TOGETHER)
            exact = np.zeros((min(TOGETHER, len(item) - a), len(known)), np.float32)
            exact[passage[own] - a, column[own]] = (weight * space.idf[word_of])[own]
            blocks.append((a, np.flatnonzero(long[item[a : a + TOGETHER]]), exact))
        for ids, key, word, row in table_slices(batches):
            number, start = runs_of(key)
            n = len(start)
            if not n or not len(item):
                continue
            at = times(None, number, word, n, dense)
            length = np.bincount(number, weights=space.idf[word] ** 2, minlength=n)
            after = followed(key[start])
            joined = np.flatnonzero(after)
            both = np.concatenate([unit(at), unit(at[joined] + at[joined + 1])])
            one = np.concatenate([np.arange(n), joined])
            two = np.concatenate([np.full(n, -1), joined + 1])
            size = np.sqrt(np.concatenate([length, length[joined] + length[joined + 1]]))
            # Of the words only those of items matter for the exact cosine.
            mine = np.flatnonzero(place[word] >= 0)
            known_words, ends = place[word[mine]], np.searchsorted(number[mine], np.arange(n + 1))
            found = []
            for a, usable, exact in blocks:
                for s in range(0, len(both), 4096):
                    p, k = np.divmod(np.flatnonzero(both[s : s + 4096] @ latent[:, a + usable] >= cosine), max(1, len(usable)))
                    p, k = p + s, usable[k]
                    if exact_cosine is not None:
                        shared = dots(one[p], k, known_words, ends, exact)
                        second = np.flatnonzero(two[p] >= 0)
                        shared[second] += dots(two[p[second]], k[second], known_words, ends, exact)
                        ok = shared >= np.maximum(exact_cosine * size[p], covered * norm[a + k])
                        p, k = p[ok], k[ok]
                    found.append(np.unique(row[start[one[p]]] * (1 << 32) + item[a + k]))
            pair = np.unique(np.concatenate(found))
            own, first = runs_of(pair >> 32)
            if len(first):
                items_of = pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array((pair >> 32)[first])), items_of], schema=schema)

    found = table.mapInArrow(run, "doc_id bigint, item array<int>")
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("item"))).alias("item"))


def dots(p: np.ndarray, k: np.ndarray, words: np.ndarray, ends: np.ndarray, exact: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """Sums of the weights in row k of exact of the words of half passage p, for many pairs: their first words, then their second ones and so on."""
    out = np.zeros(len(p), np.float32)
    flat = exact.ravel()
    for a in range(0, len(p), most):
        first, many = ends[p[a : a + most]], ends[p[a : a + most] + 1] - ends[p[a : a + most]]
        order = np.argsort(-many, kind="stable")
        first, row, left = first[order], k[a : a + most][order] * exact.shape[1], np.searchsorted(-many[order], -np.arange(many.max()))
        total = np.zeros(len(order))
        for j, n in enumerate(left.tolist()):  # n have more words than j
            total[:n] += flat[row[:n] + words[first[:n] + j]]
        out[a + order] = total
    return out


def orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of a tall matrix, by way of their small Gram matrix."""
    gram = np.zeros((z.shape[1], z.shape[1]))
    for a in range(0, len(z), 4096):
        part = z[a : a + 4096].astype(np.float64)
        gram += part.T @ part
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-10 * max(value[-1], 1e-300)
    turn = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    return z @ turn


def common_runs(item: np.ndarray, others: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in either text and lengths of the longest runs of at least least_run equal letters."""
    if len(item) * len(others) <= 1 << 21:
        same = item[:, None] == others[None, :]
        begin = same.copy()
        begin[1:, 1:] &= ~same[:-1, :-1]
        i, j = np.nonzero(begin)
        for step in range(1, least_run):
            ok = (i + step < len(item)) & (j + step < len(others))
            i, j = i[ok], j[ok]
            ok = same[i + step, j + step]
            i, j = i[ok], j[ok]
    else:
        # Of long texts grams are joined instead of all letters with all.
        hashes = []
        for x in (item, others):
            sums, back = prefix(x)
            n = max(0, len(x) - least_run + 1)
            hashes.append((sums[least_run : least_run + n] - sums[:n]) * back[:n])
        order = np.argsort(hashes[0], kind="stable")
        low, high = (np.searchsorted(hashes[0][order], hashes[1], side=s) for s in ("left", "right"))
        many = high - low
        j = np.repeat(np.arange(len(hashes[1])), many)
        i = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ok = (i == 0) | (j == 0) | (item[i - 1] != others[j - 1])
        i, j = i[ok], j[ok]
    run = np.full(len(i), least_run)
    alive = np.arange(len(i))
    while len(alive):
        x, y = i[alive] + run[alive], j[alive] + run[alive]
        ok = (x < len(item)) & (y < len(others))
        alive, x, y = alive[ok], x[ok], y[ok]
        alive = alive[item[x] == others[y]]
        run[alive] += 1
    return i, j, run


def held(item: np.ndarray, others: np.ndarray, least_run: int, most_gap: int, changed: float, slack: int, least: float = 0.0) -> float:
    """Share of an item's letters that one passage of other letters holds in the item's order.

    Runs of at least least_run equal letters (of long texts, as many more as chance would give) are chained into the longest common subsequence of such runs; of
    the item's letters inside the passage the share changed, and slack more, may be left out; between
    runs the passage may be interrupted by most_gap letters.  Interruptions weigh against the letters they join,
    one against one, so that single words far apart don't chain up.  0 if all runs together hold less than least.
    """
    if not len(item) or not len(others):
        return 0.0
    # Chance runs grow with the product of both lengths; longer texts need longer runs.
    least_run += max(0, (len(item) * len(others)).bit_length() - 20) // 2
    i, j, run = common_runs(item, others, least_run)
    edges = np.bincount(i, minlength=len(item) + 1) - np.bincount(i + run, minlength=len(item) + 1)
    if np.count_nonzero(np.cumsum(edges)) < least * len(item):
        return 0.0
    order = np.lexsort((i, j))
    i, j, run = (x[order].tolist() for x in (i, j, run))
    longest = max(run, default=0)
    best, held_by, left, first = [], [], [], []
    top = 0
    for k in range(len(i)):
        score, letters, missing, start = float(run[k]), run[k], 0, i[k]
        for p in range(k - 1, -1, -1):
            if j[k] - j[p] > most_gap + longest:
                break
            a, b = i[p] + run[p], j[p] + run[p]
            # Runs may overlap at their seam; the earlier one gives way.
            cut = max(0, a - i[k], b - j[k])
            if cut >= run[p] or j[k] - b > most_gap or i[p] >= i[k] or j[p] >= j[k]:
                continue
            skipped = left[p] + max(0, i[k] - a)
            if skipped > changed * (i[k] + run[k] - first[p]) + slack:
                continue
            value = best[p] + run[k] - cut - max(0, j[k] - b)
            if value > score or (value == score and skipped < missing):
                score, letters, missing, start = value, held_by[p] + run[k] - cut, skipped, first[p]
        best.append(score)
        held_by.append(letters)
        left.append(missing)
        first.append(start)
        top = max(top, letters)
    return top / len(item)


def training(documents: DataFrame) -> DataFrame:
    return documents.where((split_name("split") == "train") & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")


def item_blocks(eval_items: DataFrame, block_items: int) -> Iterator[Items]:
    """The distinct sentences of the items, keyed by their hash, in blocks of about block_items."""
    sentences = eval_items.select("key", "sentence").distinct()
    blocks = max(1, -(-sentences.count() // block_items))
    for block in range(blocks):
        rows = sentences.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key", "sentence").select("key", "sentence").collect()  # the stated query set
        yield Items.of([r["key"] for r in rows], [r["sentence"] for r in rows])


def keyed_items(eval_items: DataFrame) -> DataFrame:
    return eval_items.where("sentence is not null and item_id is not null").select("item_id", "sentence", F.xxhash64("sentence").alias("key"))


def with_candidates(train: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with the items they may hold.  A filter of fixed size, made of the candidates, keeps most others out of the join."""
    bits = id_filter(candidates, "doc_id")
    return train.where(may_hold("doc_id", bits)).join(candidates, "doc_id")


def leaked(
    documents: DataFrame, eval_items: DataFrame, share: float = 0.6, changed: float = 0.1, most_gap: int = 80, cosine: float = 0.27, exact_cosine: float = 0.22, covered: float = 0.34, rank: int = 64, rest: int = 64,
    block_items: int = 20_000, fit_passages: int | None = None, seed: int = 7,
) -> DataFrame:
    """Training documents and the evaluation items of which one passage holds at least share of the letters, in order.

    documents: doc_id, text, split; eval_items: item_id, sentence; other columns are left out.
    Result: doc_id, item_id, distinct.  Items are the stated query set, searched in one pass over the passages for each
    block_items; items of one sentence are searched once and reported each.  A long item is searched by all its passages.  Within the passage up to
    changed of the letters (and a word) may be changed or dropped; between its parts up to most_gap letters (half as
    many of Han) may stand: line breaks, numbers and list marks have no letters and labels before a line's text are left out,
    and so are, in a second look, lines that stand more than once in the document (refrains, of any length) and stock replies.
    Null and blank texts and sentences, and documents of other splits, give no row.  Sentences of fewer than SHORT
    letters (Han counted three times) are no passage that a cosine could tell: their grams are looked up in all texts, and those of fewer
    letters than one gram of 8 (Han 4) are found where all their letters stand as whole words.  Texts may be of any length.
    """
    spark: SparkSession = documents.sparkSession
    train, keyed = training(documents), keyed_items(eval_items)
    space = table = found = None
    for items in item_blocks(keyed, block_items):
        rule = (share, changed, most_gap)
        if items.long().any():
            if space is None:
                table = written(passage_table(train))
                space = latent_space(table, seed, rank, rest, fit_passages)
            candidates = written(near(table, items, space, cosine, exact_cosine, covered))
            one = checked(with_candidates(train, candidates), items, *rule)
            found = one if found is None else found.unionByName(one)
        if len(items.short()):
            one = checked(train.withColumn("item", F.lit(None).cast("array<int>")), items, *rule)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return found.distinct().join(keyed.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()


def checked(documents: DataFrame, items: Items, share: float, changed: float, most_gap: int) -> DataFrame:
    """Documents and keys of the items they hold, of those named by item; where that is null, of the short items."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(items)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = model.value
        short = items.short()
        for batch in batches:
            for a, b in row_slices(batch["text"]):
                text = read_letters(*code_points(batch["text"][a:b]), drop_labels=True)
                named = batch["item"][a:b]
                plain = named.null_count == b - a
                if plain:
                    row, item = np.repeat(np.arange(b - a), len(short)), np.tile(short, b - a)
                else:
                    row, item = np.repeat(np.arange(b - a), np.diff(named.offsets.to_numpy())), named.flatten().to_numpy().astype(np.int64)
                pairs = check(text, items, np.sort(row * (1 << 32) + item), share, changed, most_gap)
                if plain:
                    pairs += exact(text, items)
                ids = batch["doc_id"][a:b].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[[d for d, _ in pairs]], pa.int64()), pa.array([items.keys[k] for _, k in pairs], pa.int64())], schema=schema)

    return documents.select("doc_id", "text", "item").mapInArrow(run, "doc_id bigint, key bigint")


def exact(text: Text, items: Items) -> list[tuple[int, int]]:
    """Row and item pairs of items too short for a gram, whose letters a row holds as whole words."""
    gramless = np.setdiff1d(np.arange(len(items.keys)), items.row).tolist()
    by_size: dict[int, dict[int, list[int]]] = {}
    for k in gramless:
        size = len(items.letters[k])
        if size:
            by_size.setdefault(size, {}).setdefault(int(prefix(items.letters[k])[0][size]), []).append(k)
    n = len(text.letter)
    if not by_size or not n:
        return []
    sums, back = prefix(text.letter)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (text.word[1:] != text.word[:-1]) | text.han[1:] | text.han[:-1]
    found: set[tuple[int, int]] = set()
    for size, known in by_size.items():
        if size > n:
            continue
        value = (sums[size:] - sums[: n - size + 1]) * back[: n - size + 1]
        ok = np.isin(value, np.array(list(known), np.uint64)) & edge[: n - size + 1] & edge[size:] & (text.row[: n - size + 1] == text.row[size - 1 :])
        at = np.flatnonzero(ok)
        found.update((row, k) for row, v in zip(text.row[at].tolist(), value[at].tolist()) for k in known[v])
    return sorted(found)


def own_hits(text: Text, items: Items, wanted: np.ndarray, least: float) -> dict[tuple[int, int], np.ndarray]:
    """Letters at which grams of an item begin, for the wanted rows and items of whose grams a row holds the share least."""
    at, gram = items.hits(text)
    order = np.argsort(items.gram, kind="stable")
    of = items.row[order]
    ends = np.searchsorted(items.gram[order], np.arange(len(items.grams) + 1))
    many = np.diff(ends)[gram]
    hit = np.repeat(np.arange(len(at)), many)
    item = of[np.repeat(ends[gram] - (np.cumsum(many) - many), many) + np.arange(many.sum())] if len(hit) else np.zeros(0, np.int64)
    pair = text.row[at[hit]] * (1 << 32) + item
    ok = np.flatnonzero(among(pair, wanted)) if len(wanted) else np.zeros(0, np.int64)
    hit, pair = hit[ok], pair[ok]
    name, number = np.unique(pair, return_inverse=True)
    seen = np.unique(number * (1 << 32) + gram[hit]) >> 32
    grams = np.bincount(items.row, minlength=len(items.keys))
    enough = np.bincount(seen, minlength=len(name)) >= least * grams[name & 0xFFFFFFFF]
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(len(name) + 1))
    return {(int(name[k] >> 32), int(name[k] & 0xFFFFFFFF)): at[hit[order[bounds[k] : bounds[k + 1]]]] for k in np.flatnonzero(enough).tolist()}


def check(text: Text, items: Items, wanted: np.ndarray, share: float, changed: float, most_gap: int) -> list[tuple[int, int]]:
    """Row and item pairs of a slice of documents, of the wanted ones (row and item as one number, sorted), that hold the share of the item.

    A passage that holds the share, with a tenth of its words changed and in pieces of a line, has half of the share of the item's grams at the least.
    """
    goals = own_hits(text, items, wanted, share / 2)
    if not goals:
        return []
    found: set[tuple[int, int]] = set()
    heads = np.searchsorted(text.row, np.arange(int(text.row[-1]) + 2))
    idle, grams = interruptions(text), np.bincount(items.row, minlength=len(items.keys))
    for (row, k), near_letters in goals.items():
        low, high = heads[row], heads[row + 1]
        letter, place, han = text.letter[low:high], text.place[low:high], text.han[low:high]
        own = near_letters - low
        need = grams[k] * share / 2
        if any_held(letter, place, place[own], items, k, share, changed, most_gap, need):
            found.add((row, k))
            continue
        mute = idle[low:high]
        if not mute.any():
            continue
        # The same without refrains and stock replies; then with those lines of them that have a gram of the item.
        kept = np.isin(text.line[low:high], text.line[low:high][own])
        views = [~mute, ~mute | kept] if (mute & kept).any() else [~mute]
        for view in views:
            weight = np.cumsum(np.where(han, HAN_WEIGHT, 1) * view) - 1
            if view.any() and any_held(letter[view], weight[view], np.maximum(weight[own[view[own]]], 0), items, k, share, changed, most_gap, need):
                found.add((row, k))
                break
    return sorted(found)


def any_held(letter: np.ndarray, place: np.ndarray, starts: np.ndarray, items: Items, k: int, share: float, changed: float, most_gap: int, need: float) -> bool:
    """Whether one stretch of a row's letters holds the share of an item; starts are the places of its grams, need of which the stretch has at least."""
    han = items.han[k]
    reach = len(items.letters[k]) * 2 * (HAN_WEIGHT if han else 1) + 2 * HALF
    starts = np.sort(starts)
    # Grams that begin a stretch with enough of them, and those in it.
    ends = np.searchsorted(starts, starts + reach, side="right")
    enough = np.flatnonzero(ends - np.arange(len(starts)) >= need)
    dense = np.cumsum(np.bincount(enough, minlength=len(starts) + 1) - np.bincount(ends[enough], minlength=len(starts) + 1))[:-1] > 0
    starts = starts[dense]
    if not len(starts):
        return False
    edge = np.flatnonzero(np.diff(starts) > reach)
    for x, y in zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist()):
        p, q = np.searchsorted(place, [x - reach // 2, y + reach // 2])
        for at in range(p, q, 8192):  # long stretches of one item go in overlapping parts
            part = letter[max(p, at - reach) : min(q, at + 8192)]
            if held(items.letters[k], part, 2 if han else 5, most_gap // 2 if han else most_gap, changed, 4 if han else 8, share) >= share:
                return True
    return False


def common_words(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence of two short sequences, a row of the table at a time."""
    row = np.zeros(len(words) + 1, np.int64)
    for w in item:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (words == w)))
    return int(row[-1])


def paraphrased(
    documents: DataFrame, eval_items: DataFrame, cosine: float = 0.9, order: float = 0.5, telling: int = 4, answer: float = 0.75, rank: int = 64, block_items: int = 20_000, fit_passages: int | None = None, seed: int = 7
) -> DataFrame:
    """Training documents one of whose passages says what an item says in other words: doc_id, item_id, words, answer, distinct.

    documents and eval_items as of leaked().  Passages are searched by cosine in the semantic dimensions of the SVD alone, in which words
    that stand in the same company are near.  Candidates are checked in the text: words is the share of the item's words that the passage, twice as long
    as the item at most, holds in the item's order, at least order; answer is the share of the item's telling words, the
    rarest of the corpus, that it holds, at least answer.  Items of fewer than SHORT letters are left out, and so are null and blank texts.
    """
    spark = documents.sparkSession
    train, keyed = training(documents), keyed_items(eval_items)
    space = table = found = None
    for items in item_blocks(keyed, block_items):
        if not items.long().any():
            continue
        if space is None:
            table = written(passage_table(train))
            space = latent_space(table, seed, rank, 0, fit_passages)
        candidates = written(near(table, items, space, cosine, None))
        model = spark.sparkContext.broadcast((items.keys, items.words, space.idf))
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("words", pa.float64()), ("answer", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            keys, words_of, idf = model.value
            rarest = [np.unique(x)[np.argsort(-idf[np.unique(x)], kind="stable")][:telling] for x in words_of]
            asked = [x.tolist() for x in rarest]
            for batch in batches:
                for a, b in row_slices(batch["text"]):
                    text = read_letters(*code_points(batch["text"][a:b]), drop_labels=True)
                    first, word = word_hashes(text)
                    heads = np.searchsorted(text.row[first], np.arange(b - a + 1))
                    rows = []
                    for r, (doc, named) in enumerate(zip(batch["doc_id"][a:b].to_pylist(), batch["item"][a:b].to_pylist())):
                        own = word[heads[r] : heads[r + 1]]
                        present = set(own.tolist())
                        for k in named:
                            # No window holds more of the telling words than the whole row.
                            if sum(w in present for w in asked[k]) / max(1, len(asked[k])) < answer:
                                continue
                            best = best_passage(own, words_of[k], rarest[k], order, answer)
                            if best:
                                rows.append((doc, keys[k], *best))
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(schema.types)], schema=schema)

        one = with_candidates(train, candidates).mapInArrow(run, "doc_id bigint, key bigint, words double, answer double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, words double, answer double")
    best = found.groupBy("doc_id", "key").agg(F.max(F.struct("words", "answer")).alias("r"))
    return best.join(keyed.select("key", "item_id"), "key").select("doc_id", "item_id", "r.words", "r.answer").distinct()


def best_passage(own: np.ndarray, item: np.ndarray, rarest: np.ndarray, order: float, answer: float) -> tuple[float, float] | None:
    """The greatest share of an item's words in order, and of its telling words, in a window of a row's words; None below the least."""
    if not len(own) or not len(item):
        return None
    size, best = 2 * len(item), None
    telling = np.stack([np.concatenate([[0], np.cumsum(own == w)]) for w in rarest])
    starts = np.arange(0, max(1, len(own) - len(item)), len(item))
    stops = np.minimum(len(own), starts + size)
    answers = np.mean(telling[:, stops] > telling[:, starts], axis=0)
    for start, stop, has in zip(*(x[answers >= answer].tolist() for x in (starts, stops, answers))):
        words = common_words(item, own[start:stop]) / len(item)
        if words >= order and (best is None or (words, has) > best):
            best = (words, has)
    return best
