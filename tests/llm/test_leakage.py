"""Leakage: planted passages, shuffled and short ones, and recall against the check on every pair."""

import inspect
import random

import numpy as np
import pytest

from utterlake.llm.leakage import common_runs, dots, latent_space, leaked, paraphrased, times

PICK = random.Random(12)
WORDS = ["".join(PICK.choice("ابپتجچخدرزسشصطعفقکگلمنوهی") for _ in range(PICK.randrange(2, 8))) for _ in range(600)]
LATIN = ["".join(PICK.choice("abcdefghiklmnoprstuvwy") for _ in range(PICK.randrange(2, 9))) for _ in range(600)]
HAN = "山水木火土金日月人口手足目耳心大小上下左右前后春夏秋冬红白黑青黄东西南北马牛羊鸟鱼花草云雨"


def sentences(rng, n, kind):
    if kind == "han":
        return ["".join(rng.choice(HAN) for _ in range(36)) for _ in range(n)]
    pool = WORDS if kind == "fa" else LATIN
    return [" ".join(rng.choice(pool) + rng.choice(["", "ها", "مان"] if kind == "fa" else ["", "s"]) for _ in range(15)) for _ in range(n)]


def test_planted(spark):
    rng = random.Random(4)
    items = sentences(rng, 25, "fa") + sentences(rng, 8, "en") + sentences(rng, 8, "han")
    rows, want = [], set()
    noise = lambda: ". ".join(sentences(rng, 6, rng.choice(["fa", "fa", "en"])))

    def add(text, k=None, split="train"):
        rows.append((len(rows), f"{noise()}\n{text}\n{noise()}", split, 7))
        if k is not None:
            want.add((len(rows) - 1, k))

    for k, item in enumerate(items):
        han = " " not in item
        parts = list(item) if han else item.split()
        join = "" if han else " "
        add(item, k)
        add(join.join(parts[: int(len(parts) * 0.75)]), k)
        add(item, split="test")
        add(join.join(parts[: len(parts) // 3]))
        shuffled = parts[:]
        rng.shuffle(shuffled)
        add(join.join(shuffled))
        changed = parts[:]
        changed[len(parts) // 2] = "火" if han else "دیگری"
        add(join.join(changed), k)
        half = len(parts) // 2
        add(f"1\n00:01:02,000 --> 00:01:04,000\nمجری: {join.join(parts[:half])}\n\n2\n00:01:05,000 --> 00:01:07,000\nمهمان: {join.join(parts[half:])}", k)
        if not han:
            add(item.replace("ی", "ي").replace("ک", "ك").replace("a", "а").replace(" ", "　").replace("ا", "اـ"), k)
    docs = spark.createDataFrame([*rows, (9998, None, "train", 1), (9999, "", "train", 1), rows[0]], "doc_id bigint, text string, split string, item_id int")
    evals = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(100, items[0], "x"), (101, None, "x"), (102, " ", "x")], "item_id bigint, sentence string, doc_id string")
    want |= {(d, 100) for d, k in want if k == 0}
    got = {tuple(r) for r in leaked(docs, evals).collect()}
    assert got == want
    assert {tuple(r) for r in leaked(docs, evals, block_items=10, fit_passages=50).collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, split string")
    evals = spark.createDataFrame([(1, "کتاب دریا خانه درخت پنجره باران")], "item_id bigint, sentence string")
    assert leaked(docs, evals).count() == 0
    some = spark.createDataFrame([(1, "x", "train")], "doc_id bigint, text string, split string")
    assert leaked(some, evals.limit(0)).count() == 0
    assert leaked(some, spark.createDataFrame([(1, " ")], "item_id bigint, sentence string")).count() == 0
    long = spark.createDataFrame([(1, "سلام دنیا " * 200_000 + "کتاب دریا خانه درخت پنجره باران", "train")], "doc_id bigint, text string, split string")
    assert leaked(long, evals).count() == 1


def test_refrains(spark):
    # Lines of an item with a longer refrain between them; the refrain may also be a line of the item itself.
    rng = random.Random(6)
    rows, want = [], set()
    items = sentences(rng, 6, "fa")
    for k, item in enumerate(items):
        words = item.split()
        lines = [" ".join(words[a : a + 3]) for a in range(0, 15, 3)]
        noise = sentences(rng, 3, "fa")
        for n in (6, 14, 40):
            refrain = " ".join(rng.choice(WORDS) for _ in range(n))
            rows.append((len(rows), "\n".join([noise[0], *(x for line in lines for x in (line, refrain)), noise[1]]), "train"))
            want.add((len(rows) - 1, k))
        rows.append((len(rows), "\n".join([noise[0], *(x for line in lines for x in (line, lines[0])), noise[1]]), "train"))
        want.add((len(rows) - 1, k))
        # Other lines that stand once are no refrain, and repeated lines in another order are no case.
        rows.append((len(rows), "\n".join([noise[0], *(x for line in lines for x in (line, " ".join(rng.choice(WORDS) for _ in range(30)))), noise[1]]), "train"))
        rows.append((len(rows), "\n".join([noise[0], *lines[::-1], noise[2], *lines[::-1], noise[1]]), "train"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    evals = spark.createDataFrame(list(enumerate(items)), "item_id bigint, sentence string")
    assert {tuple(r) for r in leaked(docs, evals).collect()} == want


def test_short_items(spark):
    rng = random.Random(8)
    items = [(1, "آب نان"), (2, "春山"), (3, "Tea!"), (4, "..."), (5, sentences(rng, 1, "fa")[0]), (6, "آب نان"), (7, "tea")]
    rows = [(1, "او آب\nنان خورد"), (2, "آن آب نانوا"), (3, "今天春山好"), (4, "a steam tea"), (5, "steam teas"), (6, items[4][1]), (7, "نان آب"), (8, "春"), (9, "山")]
    docs = spark.createDataFrame([(k, t, "train") for k, t in rows] + [(10, "tea", "test")], "doc_id bigint, text string, split string")
    evals = lambda x: spark.createDataFrame(x, "item_id bigint, sentence string")
    want = {(1, 1), (1, 6), (3, 2), (4, 3), (4, 7)}
    assert {tuple(r) for r in leaked(docs, evals(items)).collect()} == want | {(6, 5)}
    # A block without any gram is searched too.
    assert {tuple(r) for r in leaked(docs, evals([x for x in items if x[0] != 5])).collect()} == want


@pytest.mark.parametrize("letters", [100, 800, 1100, 2100, 10_000])
def test_long_items(spark, letters):
    # Long items are found whole, by two thirds, and beside short ones; half of one is no case.
    rng = random.Random(letters)
    item = " ".join(sentences(rng, letters // 60, "fa"))
    other = sentences(rng, 1, "fa")[0]
    words = item.split()
    noise = " ".join(sentences(rng, 20, "fa"))
    rows = [(1, f"{noise}. {item}. {noise}", "train"), (2, f"{noise}. {' '.join(words[: int(len(words) * 0.68)])}. {noise}", "train"), (3, f"{noise}. {' '.join(words[: len(words) // 2])}. {noise}", "train"), (4, f"{noise}. {other}", "train"), (5, noise, "train")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    evals = spark.createDataFrame([(1, item), (2, other)], "item_id bigint, sentence string")
    assert {tuple(r) for r in leaked(docs, evals).collect()} == {(1, 1), (2, 1), (4, 2)}


def test_common_runs_by_grams_equal_those_by_letters():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 6, 1700)
    b = np.concatenate([rng.integers(0, 6, 900), a[200:700], rng.integers(0, 6, 300)])
    small, large = common_runs(a[:1200], b, 7), common_runs(a, b, 7)
    want = {x for x in zip(*map(list, large)) if x[0] + x[2] <= 1200}
    assert want <= set(zip(*map(list, small))) and len(want) >= 5


def test_paraphrases(spark):
    # Pairs of words for one thing stand in the same company in the corpus, never side by side; the documents say the items with the other word of each pair.
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    topics = [[(word(), word()) for _ in range(12)] for _ in range(12)]
    corpus = [(k, " ".join(rng.choice(pair) for pair in rng.choices(topics[k % 12], k=18)), "train") for k in range(600)]
    names = [word() for _ in range(12)]
    items = [(k, " ".join([x[0] for x in topics[k][:10]] + [names[k]])) for k in range(12)]
    told = lambda k: " ".join([x[0] for x in topics[k][:3]] + [x[1] for x in topics[k][3:10]] + [names[k]])
    rows = corpus + [(1000 + k, told(k), "train") for k in range(12)] + [(2000, told(0), "test"), (2001, None, "train")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, split string")
    evals = spark.createDataFrame([*items, (50, None), (51, "x")], "item_id bigint, sentence string")
    wanted = {(1000 + k, k) for k in range(12)}
    found = lambda **x: {(r.doc_id, r.item_id) for r in paraphrased(docs, evals, rank=12, **x).collect() if r.doc_id >= 1000}
    assert wanted == found(telling=1, answer=1.0, order=0.3)
    # Without the space of the corpus they are lost; the plain cosine of a third of the words is far below.
    assert not wanted & found(telling=1, answer=1.0, order=0.3, fit_passages=1)
    assert not {tuple(r) for r in leaked(docs, evals).collect()} & wanted
    assert paraphrased(docs.limit(0), evals).count() == 0 and paraphrased(docs, evals.limit(0)).count() == 0


def test_space_of_all_passages(spark):
    # Each document has a pair of words of its own in all its 25,000 half passages, so a document left out of the fit has no direction.
    table = spark.range(8).selectExpr("id AS doc_id", "flatten(transform(sequence(0, 24999), x -> array(int(x), int(x)))) AS half", "flatten(array_repeat(array(int(2 * id), int(2 * id + 1)), 25000)) AS word")
    for operator in (leaked, paraphrased):
        space = latent_space(table, 7, 12, 0, inspect.signature(operator).parameters["fit_passages"].default)
        lengths = np.linalg.norm(space.basis.astype(float), axis=1)
        assert np.allclose(lengths[:16], 0.5**0.5, atol=0.01) and not lengths[16:].any()


def test_times():
    # Rows without entries, short and long ones, and longer than a block.
    rng = np.random.default_rng(3)
    number = np.repeat(np.arange(9), [0, 3, 1, 0, 70, 3, 2, 300, 0])
    word, weight, dense = rng.integers(0, 50, len(number)), rng.random(len(number)).astype(np.float32), rng.random((50, 5)).astype(np.float32)
    full = np.zeros((9, 50))
    for w, by in ((weight, weight), (None, np.ones(len(number)))):
        full[:] = 0
        np.add.at(full, (number, word), by)
        assert np.allclose(times(w, number, word, 9, dense, most=64), full @ dense, rtol=1e-4)
    assert times(None, number[:0], word[:0], 0, dense).shape == (0, 5)


def test_dots():
    rng = np.random.default_rng(4)
    ends = np.cumsum([0, 3, 0, 12, 1, 40])
    words, exact = rng.integers(0, 30, ends[-1]), rng.random((6, 30)).astype(np.float32)
    p, k = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(6)))
    want = [exact[y, words[ends[x] : ends[x + 1]]].sum() for x, y in zip(p, k)]
    assert np.allclose(dots(p, k, words, ends, exact, most=7), want, rtol=1e-5)
    assert not len(dots(p[:0], k[:0], words, ends, exact))
